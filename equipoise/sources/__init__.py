"""Scans, sinks, verified ingest, export names and deterministic data."""
