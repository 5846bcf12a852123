"""Spark-native analytics over build and test failures."""
