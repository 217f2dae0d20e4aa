"""Column expressions: pure functions of a row."""
