"""Column builders: text, money, dates, lists."""
