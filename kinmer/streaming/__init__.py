"""Incremental runs over files that arrive."""
