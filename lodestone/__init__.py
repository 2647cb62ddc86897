"""Spark-native engine for governed evidence retrieval and training-data preparation."""
