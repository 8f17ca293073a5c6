"""Streams of tiles and of events. Additions: the tile formats themselves know no time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tiles


def read_stream(spark: SparkSession, path: str, columns: str | None = None, log: str | None = None) -> DataFrame:
    """Features of tile files as they arrive under a path; log: a folder that names what has been read, for restarts."""
    tiles.register(spark)
    reader = spark.readStream.format("vtile").option("path", path)
    for k, v in (("columns", columns), ("log", log)):
        reader = reader.option(k, v) if v else reader
    return reader.load()


def layer_counts(features: DataFrame) -> DataFrame:
    """Running counts of features by layer; the state is a row per layer."""
    return features.groupBy("layer").agg(F.count("*").alias("n_features"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and event type, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: their start and number of events."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
