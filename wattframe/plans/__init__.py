"""Queries: each returns a DataFrame built on the operators."""
