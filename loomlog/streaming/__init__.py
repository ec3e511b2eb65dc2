"""Continuous forms: tails, ingest, counters and windowed counts on Structured Streaming."""
