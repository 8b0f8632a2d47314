"""Column functions: text, numbers, hashes."""
