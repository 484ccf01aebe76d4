"""Spark-native engine for tiled raster exports and the relational steps around them."""

__version__ = "0.1.0"
