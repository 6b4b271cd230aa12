"""Structured Streaming forms of ingest, breakers and cache."""
