"""Column expressions: text quality, routing, citations."""
