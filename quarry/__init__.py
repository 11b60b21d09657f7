"""Spark-native source and corpus quality engine."""
