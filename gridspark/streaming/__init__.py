"""Structured Streaming: arrivals, ingest and visibility."""
