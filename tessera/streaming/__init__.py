"""Streams: file intake and events."""
