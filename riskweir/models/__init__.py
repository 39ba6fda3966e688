"""MLlib pipelines, search, ablation, importance and the scoring artifact."""
