"""Column expressions: normalisation, key representations and column names."""
