"""Composed analyses: bridge views, materialised tables and the query catalogue."""
