"""Column expressions: money, accounts, dates, names, texts."""
