"""Structured Streaming over node versions and events."""
