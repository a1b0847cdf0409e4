"""Spark-native analytics over panels of entities observed in periods."""
