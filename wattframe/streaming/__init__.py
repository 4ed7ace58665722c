"""Continuous price ingest and resampling with Structured Streaming."""
