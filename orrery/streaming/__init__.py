"""Streams over arriving rows."""
