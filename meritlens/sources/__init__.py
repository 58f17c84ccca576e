"""Readers, record repair, resume parsing and sinks."""
