"""File scans, rule tables, and sinks."""
