"""Structured Streaming jobs and the batch-committed tables they fill."""
