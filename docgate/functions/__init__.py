"""docgate.functions."""
