"""Spark-native analytics over tiled geographic data: codecs, sources, sinks and reshaping."""
