"""Incremental ingest and drift guards."""
