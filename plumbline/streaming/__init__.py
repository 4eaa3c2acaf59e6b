"""Streaming ingestion of performance history."""
