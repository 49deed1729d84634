"""Queries on small literal rows, each with its SQL or its expected rows: tests of operators whose facts no common table holds."""
