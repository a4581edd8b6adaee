"""Progressive answers through Structured Streaming."""
