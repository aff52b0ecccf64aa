"""Column expressions and the small parsers they cannot replace."""
