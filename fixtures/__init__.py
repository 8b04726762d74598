"""Check inputs: maps the given tables onto the library's shapes, and the SQL each query is checked against."""
