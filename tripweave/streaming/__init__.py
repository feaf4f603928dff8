"""Structured Streaming jobs over the search feed."""
