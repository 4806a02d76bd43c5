"""Incremental refreshes."""
