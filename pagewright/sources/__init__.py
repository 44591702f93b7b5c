"""Scans, parsers of landed files, and sinks."""
