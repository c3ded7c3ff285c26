"""Structured Streaming jobs over account events."""
