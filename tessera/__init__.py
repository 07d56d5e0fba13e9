"""Spark-native retrieval, code-analytics and training-data engine."""
