"""Readers of archive records and captured device bytes."""
