"""Incremental merging of fact batches with Structured Streaming."""
