"""Spark-native research engine for event and panel data."""
