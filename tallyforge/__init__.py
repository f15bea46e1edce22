"""Spark-native scoring, entity-resolution and sequence analytics."""
