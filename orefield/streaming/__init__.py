"""The incremental shapes on Structured Streaming."""
