"""Composed plans and the query catalogue."""
