"""Spark operators for recorded web-fetch traffic and raw pages."""
