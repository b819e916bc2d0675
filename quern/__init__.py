"""Spark-native decision and graph analytics."""
