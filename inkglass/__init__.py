"""inkglass: Spark-native overlap, citation and corpus analytics."""

__version__ = "0.1.0"
