"""Operators over file tables: keyword scans, discovery, findings, dependencies, closures, metrics."""
