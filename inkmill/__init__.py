"""Spark-native preparation, storage and retrieval of long-form text."""
