"""Semantic-cache and training-data analytics on Spark."""
