"""Telemetry analytics as Spark DataFrame operators and studies."""
