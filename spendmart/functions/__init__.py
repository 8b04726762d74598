"""Column-level helpers: every function maps Columns to Columns and stays inside codegen."""
