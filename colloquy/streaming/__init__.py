"""Streaming forms of ingest, de-duplication and rolling counts."""
