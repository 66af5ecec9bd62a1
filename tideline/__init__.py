"""tideline: event-log projections on Spark DataFrames and Structured Streaming."""
