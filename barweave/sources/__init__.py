"""Scans, derived tables and sinks."""
