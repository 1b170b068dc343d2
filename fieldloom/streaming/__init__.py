"""Structured Streaming counterparts of the learning loop."""
