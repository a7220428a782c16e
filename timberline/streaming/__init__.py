"""Structured Streaming forms of ingest, deduplication, volume and pattern matching."""
