"""Spark-native analytics over the public record of legislatures."""
