"""Incremental transcript ingest on Structured Streaming."""
