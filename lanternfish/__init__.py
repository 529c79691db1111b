"""Spark-native title resolution, engagement modelling and statistics."""
