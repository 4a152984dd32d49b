"""Restartable incremental ingest."""
