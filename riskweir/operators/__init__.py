"""DataFrame operators: cleaning, validation, aggregation, splits, metrics, audits and decisions."""
