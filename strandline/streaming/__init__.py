"""Structured Streaming ingest of edge records."""
