"""Structured Streaming forms of annotation, ingestion and expiry."""
