"""Structured Streaming twins of the per-message operators."""
