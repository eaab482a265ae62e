"""Column expressions: text, dates and numbers."""
