"""Column expressions: typing, target scales and reproducible row hashes."""
