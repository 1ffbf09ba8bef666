"""Structured Streaming jobs: the live anomaly alerts and continuous ingest."""
