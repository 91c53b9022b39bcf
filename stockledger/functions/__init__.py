"""Column-level functions built from Spark built-in expressions (no Python UDFs)."""
