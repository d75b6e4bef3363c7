"""Scans of landed files and sinks for tables and reports."""
