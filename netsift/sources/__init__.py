"""Readers for the log, list and state formats, and writers for results."""
