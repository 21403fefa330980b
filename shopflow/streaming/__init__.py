"""Structured Streaming: event ingest, windows, deduplication, and change data."""
