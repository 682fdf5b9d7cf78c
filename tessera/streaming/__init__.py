"""Structured Streaming forms. The scanner this library models has no streams; these are extensions."""
