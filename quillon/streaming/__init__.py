"""Structured Streaming front-ends: running statistics and e-processes over an unbounded log."""
