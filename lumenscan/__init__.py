"""Spark-native analytics for source code and training-data corpora."""
