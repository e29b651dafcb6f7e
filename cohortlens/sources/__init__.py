"""Scans, sinks and the dataset registry."""
