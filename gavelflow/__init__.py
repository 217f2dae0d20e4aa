"""Spark-native analytics for vehicle-auction data."""
