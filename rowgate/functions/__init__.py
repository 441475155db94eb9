"""Column-level building blocks: schema, text, dates, messages."""
