"""Spark-native analytics for time-aligned, multi-annotator evidence data."""
