"""Meridia: a DataFrame-native geospatial analytics engine for Spark."""
