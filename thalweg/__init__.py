"""thalweg: Spark-first analytics for linear networks, polygons, profiles and gridded terrain."""

__version__ = "0.1.0"
