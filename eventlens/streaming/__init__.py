"""Incremental forms as Structured Streaming."""
