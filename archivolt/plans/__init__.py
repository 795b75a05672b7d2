"""Planners: a decision and its reason for each row."""
