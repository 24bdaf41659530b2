"""Column expressions: text handling, cart parsing, text rules."""
