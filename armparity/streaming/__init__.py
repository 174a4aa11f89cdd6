"""Structured Streaming forms of the call-log operators."""
