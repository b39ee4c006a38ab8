"""Spark-native analytics for speaker verification data."""
