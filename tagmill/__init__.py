"""Spark-native operators for detection, recognition and price-tag tables."""
