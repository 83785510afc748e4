"""Column expressions: packet fields, text rendering, labels."""
