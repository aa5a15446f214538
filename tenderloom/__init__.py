"""Spark-native record integration and market analytics for procurement data."""
