"""Structured Streaming versions of the append-only log computations."""
