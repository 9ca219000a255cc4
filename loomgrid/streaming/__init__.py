"""Structured Streaming forms (an extension)."""
