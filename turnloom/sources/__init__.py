"""Transcript readers and result writers."""
