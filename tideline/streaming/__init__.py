"""Running projections on Structured Streaming."""
