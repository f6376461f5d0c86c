"""Column functions: text, identity, vectors."""
