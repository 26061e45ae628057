"""Spark-native analytics for personal time series and the notes around them."""
