"""Dictionaries as tables: building, ordering and looking up the columns of a cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, idx (by first appearance), count: each distinct value once. Counts are summed before the shuffle."""
    seen = df.groupBy(*keys, value).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    w = W.partitionBy(*keys).orderBy("first", value) if keys else W.orderBy("first", value)
    return seen.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint")).drop("first")


def by_frequency(dictionary: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A numeric dictionary indexed anew: most used first, then by value."""
    w = W.partitionBy(*keys).orderBy(F.desc("count"), value)
    return dictionary.withColumn("idx", (F.row_number().over(w) - 1).cast("bigint"))


def lookup(df: DataFrame, dictionary: DataFrame, keys: list[str], index: str, value: str, limit: int = 100_000) -> DataFrame:
    """df with ``value`` for ``index``; the dictionary is broadcast if it has no more than ``limit`` rows, else both shuffle."""
    d = dictionary.select(*keys, F.col("idx").alias(index), value)
    if d.limit(limit + 1).count() <= limit:
        d = F.broadcast(d)
    return df.join(d, [*keys, index], "left")


def lookup_in_row(values: Column, index: Column) -> Column:
    """The value at an index where the dictionary is an array in the same row: no join at all."""
    return F.get(values, index.cast("int"))


def in_order(values: Column) -> Column:
    """array<struct<idx, value>> as the values in the order of their index."""
    return F.transform(F.array_sort(values), lambda e: e.value)


def distinct_strings(strings: DataFrame, value: str) -> DataFrame:
    """One row: n distinct strings and their bytes."""
    return strings.where(F.col(value).isNotNull()).select(value).distinct().agg(F.count("*").alias("n_strings"), F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).cast("bigint").alias("n_bytes"))
