"""Spark-native price, catalogue and publication analytics."""
