"""Incremental ingest and running results."""
