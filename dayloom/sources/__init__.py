"""Scans, landed documents, high-water marks and sinks."""
