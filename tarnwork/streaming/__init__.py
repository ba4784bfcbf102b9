"""Structured Streaming over the stateless operators."""
