"""Structured Streaming forms of the continuous rules."""
