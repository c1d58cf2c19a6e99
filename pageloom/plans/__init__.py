"""Reusable plan shapes: chunked running aggregates."""
