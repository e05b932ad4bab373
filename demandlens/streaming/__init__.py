"""Structured Streaming jobs: ingest, roll-up maintenance, monitoring."""
