"""Spark-native toolkit for scholarly metadata and training-corpus preparation."""
