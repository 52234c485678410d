"""Structured Streaming: the batch operators on arriving files."""
