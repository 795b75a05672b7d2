"""Structured Streaming forms of the drive watch and of segment flushing."""
