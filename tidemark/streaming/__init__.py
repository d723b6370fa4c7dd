"""Structured Streaming jobs: arriving files, alert actions, account velocity."""
