"""Column expressions: dates, names and paths, tokens, keys."""
