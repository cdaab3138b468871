"""Column builders: amounts, dates and text."""
