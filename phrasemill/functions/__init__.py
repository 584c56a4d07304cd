"""Column functions: text, markers, families, hashes and vectors."""
