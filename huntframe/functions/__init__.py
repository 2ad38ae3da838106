"""Column expressions: normalization, enrichment, scoring."""
