"""Structured Streaming jobs and the tables they maintain."""
