"""Structured Streaming extension: rescoring as records arrive."""
