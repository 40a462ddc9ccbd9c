"""Structured Streaming over event tables, and run status."""
