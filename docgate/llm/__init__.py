"""Operators for preparing training data. Nothing else in docgate imports this subpackage."""
