"""Live bars and live scoring with Structured Streaming."""
