"""Spark-native analytics over ordered event sequences."""
