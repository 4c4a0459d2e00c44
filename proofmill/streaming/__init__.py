"""Structured Streaming forms of the run life cycle."""
