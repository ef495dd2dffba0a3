"""Spark-native engine for evaluating structured facts extracted from literature."""
