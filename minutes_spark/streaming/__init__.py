"""Incremental runs over files that keep arriving."""
