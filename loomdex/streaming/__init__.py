"""Structured Streaming: change events."""
