"""Column expressions and a few Arrow helpers."""
