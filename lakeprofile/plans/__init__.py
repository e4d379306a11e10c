"""Composite jobs: profile a location, preview, report."""
