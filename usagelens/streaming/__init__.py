"""Structured Streaming forms of ingest, counters and admission."""
