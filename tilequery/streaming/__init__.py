"""Structured Streaming: scenes embedded as they arrive."""
