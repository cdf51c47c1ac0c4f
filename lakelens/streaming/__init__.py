"""Structured Streaming over ledgers and event tables."""
