"""Structured Streaming forms of the interval operators."""
