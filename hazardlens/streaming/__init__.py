"""Structured Streaming jobs over the shared operators."""
