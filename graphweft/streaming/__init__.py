"""Extension: graphs from event streams, with Structured Streaming."""
