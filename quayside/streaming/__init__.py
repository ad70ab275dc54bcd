"""Structured Streaming forms of the batch transformations."""
