"""Spark-native operators for catalogue, cartographic and corpus data."""
