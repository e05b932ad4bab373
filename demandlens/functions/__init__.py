"""Column functions: text normalisation, query parsing, hashing, movement."""
