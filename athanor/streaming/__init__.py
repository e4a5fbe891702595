"""Incremental expansion of newly arriving molecules."""
