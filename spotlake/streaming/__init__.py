"""Incremental load of a table folder with Structured Streaming."""
