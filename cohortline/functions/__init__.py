"""Column expressions: text, number, time, value and array helpers."""
