"""Gleanery: a Spark-native engine for measuring and cleaning very large text corpora."""
