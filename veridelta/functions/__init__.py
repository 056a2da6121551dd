"""Column builders: each takes columns and gives a column that Catalyst inlines."""
