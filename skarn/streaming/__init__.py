"""Incremental processing on Structured Streaming."""
