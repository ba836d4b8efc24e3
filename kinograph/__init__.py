"""kinograph: Spark-native analytics for interaction logs and scene-segmented media."""

__version__ = "0.1.0"
