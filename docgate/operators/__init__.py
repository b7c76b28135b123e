"""docgate.operators."""
