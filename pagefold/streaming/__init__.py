"""Structured Streaming versions of the event-log operators."""
