"""Operators for training-data pipelines, with their queries. Nothing else in the library imports this package."""
