"""Column expressions with NumPy's results where Spark's own differ."""
