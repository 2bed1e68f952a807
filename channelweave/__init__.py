"""Spark-native value/structure information analytics."""
