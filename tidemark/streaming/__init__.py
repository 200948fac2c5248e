"""Incremental ingest as Structured Streaming jobs."""
