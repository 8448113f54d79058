"""Incremental work as Structured Streaming."""
