"""Structured Streaming: windows with late data, recursive filters as state, idempotent output."""
