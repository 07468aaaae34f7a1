"""Structured Streaming forms of the staged loads."""
