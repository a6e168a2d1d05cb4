"""Streams: files that keep arriving, and windows on event time."""
