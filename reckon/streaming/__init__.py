"""Incremental ingestion of source units with Structured Streaming."""
