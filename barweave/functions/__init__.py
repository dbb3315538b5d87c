"""Column expressions and the distributed ranking helpers."""
