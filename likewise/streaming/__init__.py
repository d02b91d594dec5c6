"""Structured Streaming forms of two log operators."""
