"""Spark-native evidence-timeline analytics: byte scans, interval algebra, time axis, event index, statistics."""
