"""Spark-native transaction risk analytics."""
