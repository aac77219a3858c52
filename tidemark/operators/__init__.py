"""Joins, windows and aggregates on per-match telemetry, DataFrame in and DataFrame out."""
