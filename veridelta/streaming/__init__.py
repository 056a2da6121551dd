"""Structured Streaming forms of the aggregates that merge."""
