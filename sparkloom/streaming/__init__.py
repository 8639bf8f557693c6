"""Incremental and windowed variants as Structured Streaming queries."""
