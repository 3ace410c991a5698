"""Column expressions: text, money, dates, parties, display values and boxes."""
