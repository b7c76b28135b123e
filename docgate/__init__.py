"""docgate: document intake and corpus preparation as PySpark DataFrame operators."""
