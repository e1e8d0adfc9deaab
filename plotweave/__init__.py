"""Spark-native analytics over geospatial features, and operators for training data."""
