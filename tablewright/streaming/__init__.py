"""Feeds that arrive as streams of files."""
