"""Structured Streaming forms of ingest, request reuse, status and activity."""
