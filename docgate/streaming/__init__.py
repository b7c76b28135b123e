"""docgate.streaming."""
