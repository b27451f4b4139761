"""Incremental forms of the index."""
