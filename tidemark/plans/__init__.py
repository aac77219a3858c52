"""Detectors, models and studies composed from the operators."""
