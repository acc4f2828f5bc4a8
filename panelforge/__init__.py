"""Spark-native cross-sectional signal analytics."""
