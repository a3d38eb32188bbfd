"""Spark-native bathymetry evidence engine."""
