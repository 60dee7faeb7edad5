"""The load and the daily counts as Structured Streaming jobs."""
