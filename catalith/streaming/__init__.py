"""Structured Streaming forms of the request-log operators."""
