"""Spark-native customer-feedback sentiment analytics."""
