"""Spark-native analytics over money movements, calls and the records around them."""
