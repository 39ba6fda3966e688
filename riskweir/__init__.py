"""Payment-risk analytics expressed as Spark DataFrame plans, MLlib pipelines and streaming queries."""
