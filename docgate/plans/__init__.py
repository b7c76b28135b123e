"""docgate.plans."""
