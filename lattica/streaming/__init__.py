"""Structured Streaming forms of the campaign log."""
