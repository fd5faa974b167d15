"""Column-to-column functions, all built from native Spark expressions but for two small Arrow helpers."""
