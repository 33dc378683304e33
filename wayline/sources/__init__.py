"""Scans and sinks with declared schemas."""
