"""Structured Streaming versions of the row-local and daily operators."""
