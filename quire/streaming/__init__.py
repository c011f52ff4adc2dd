"""Structured Streaming jobs; each takes a streaming DataFrame or source folder."""
