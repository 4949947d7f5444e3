"""Column expressions: text, dates, vectors, and the text encoder."""
