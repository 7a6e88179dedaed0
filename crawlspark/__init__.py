"""Spark-native analytics for crawled web data."""
