"""Spark-native analytics over source repositories, commit history and traces."""
