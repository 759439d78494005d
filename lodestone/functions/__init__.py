"""Column expressions: text, numbers, periods and dates."""
