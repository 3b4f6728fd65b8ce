"""framelake: Spark-native analytics over annotated images, video and their texts."""

__version__ = "0.1.0"
