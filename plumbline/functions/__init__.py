"""Column expressions of the numeric operators."""
