"""Column functions: null rules, dates, text, numbers, tail probabilities."""
