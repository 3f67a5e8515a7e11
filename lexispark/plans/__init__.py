"""Queries: clauses, and the query language that is parsed into them."""
