"""Incremental graph maintenance."""
