"""Column expressions: text, dates, money, tax ids, patterns."""
