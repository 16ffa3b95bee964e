"""A Spark-native media query engine."""
