"""HTML reading for the extraction jobs."""
