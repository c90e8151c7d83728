"""Change data capture and Structured Streaming jobs."""
