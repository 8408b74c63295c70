"""lakestat: water-quality, geospatial and time-series analytics on Spark."""

__version__ = "0.1.0"
