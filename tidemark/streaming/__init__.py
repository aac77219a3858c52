"""Incremental builds as a file stream."""
