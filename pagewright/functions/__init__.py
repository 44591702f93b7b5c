"""Column functions: URLs, text, numbers, rules."""
