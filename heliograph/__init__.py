"""Spark-native analytics for libraries of dated, tagged and geolocated records."""

__version__ = "0.1.0"
