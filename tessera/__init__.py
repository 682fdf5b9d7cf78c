"""Spark-native analytics over collections of text files: metrics, rules, findings and dependencies."""
