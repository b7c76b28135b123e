"""docgate.sources."""
