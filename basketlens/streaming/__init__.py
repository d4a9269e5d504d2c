"""Incremental forms of the batch sources."""
