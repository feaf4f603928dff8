"""Batch operators: each takes a table set and a table of requests."""
