"""Column expressions and small driver functions that operators share."""
