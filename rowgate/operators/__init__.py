"""DataFrame operators: rows in, rows out; nothing is collected unless a docstring says so."""
