"""Readers for landed telemetry."""
