"""Column functions: text, values, urls and JSON in text."""
