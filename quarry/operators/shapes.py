"""Shapes (schemas of JSON property objects): inference over tables, widening, defaults and validation.

A shape over a table is rows of (path, type): a path is a key, ``key[]`` the elements of an array under it, ``key.sub`` a
key of an object. Types are string, u64, i64, f64, bool, null. Inference is an explode and one shuffle of partial maxima.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.codec import check_shape

#: Numbers widen in this order; other types don't mix.
RANKS = ("null", "u64", "i64", "f32", "f64", "bool", "string")


def value_type(v: Column) -> Column:
    """The type of a scalar VARIANT: whole numbers are u64 or, below zero, i64; others f64."""
    t = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return F.when(t == "STRING", "string").when(t == "BOOLEAN", "bool").when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(number != F.floor(number), "f64").when(number < 0, "i64").otherwise("u64")


def typed_paths(df: DataFrame, properties: str, keys: list[str], depth: int = 3) -> DataFrame:
    """keys, path, type of every value in a column of JSON objects, down to ``depth`` levels of objects and arrays."""
    level = df.select(*keys, F.lit("").alias("_at"), F.parse_json(F.col(properties)).alias("_v"))
    out = None
    for _ in range(depth):
        cols = ", ".join([*keys, ""]) if keys else ""
        found = df.sparkSession.sql(f"SELECT {cols} CASE WHEN e.key IS NULL THEN concat(l._at, '[]') WHEN l._at = '' THEN e.key ELSE concat(l._at, '.', e.key) END AS path, e.value AS _v FROM {{level}} AS l, LATERAL variant_explode(l._v) AS e", level=level)
        found = found.withColumn("type", value_type(F.col("_v")))
        rows = found.select(*keys, "path", "type").where(~F.col("type").isin("array", "object"))
        out = rows if out is None else out.unionByName(rows)
        level = found.where(F.col("type").isin("array", "object")).select(*keys, F.col("path").alias("_at"), "_v")
    return out


def infer(paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, type: the least type that takes all values of a path; a mix of kinds becomes string, null gives way."""
    numbers = F.col("type").isin("u64", "i64", "f32", "f64")
    kind = F.when(numbers, "number").when(F.col("type") != "null", F.col("type"))
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("type"))
    agg = paths.groupBy(*keys, "path").agg(F.max(rank).alias("rank"), F.min(kind).alias("k0"), F.max(kind).alias("k1"))
    return agg.select(*keys, "path", F.when(F.col("k0") != F.col("k1"), "string").otherwise(F.element_at(F.array(*map(F.lit, RANKS)), F.col("rank").cast("int"))).alias("type"))


def infer_last(paths: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, path, type: the type of each path's last value."""
    return paths.groupBy(*keys, "path").agg(F.max_by("type", order).alias("type"))


def widen_array(types: Column) -> Column:
    """The type for all of an array's types (names); numbers widen, any other mix is an error."""
    rank = lambda t: F.array_position(F.array(*map(F.lit, RANKS)), t)
    numbers = F.forall(types, lambda t: t.isin("u64", "i64", "f32", "f64"))
    same = F.size(F.array_distinct(types)) <= 1
    return F.when(same, F.get(types, 0)).when(numbers, F.element_at(F.array(*map(F.lit, RANKS)), F.array_max(F.transform(types, rank)).cast("int"))).otherwise(F.raise_error(F.lit("an array's types must be the same")).cast("string"))


DEFAULTS = {"string": "''", "u64": "0", "i64": "0", "f32": "0.0", "f64": "0.0", "bool": "false", "null": "null"}


def with_defaults(properties: Column, shape: dict[str, str]) -> Column:
    """Flat JSON properties as a JSON object of exactly the shape's keys; what is missing has its type's default."""
    v = F.parse_json(properties)
    kinds = {"string": "string", "u64": "decimal(20,0)", "i64": "bigint", "f32": "float", "f64": "double", "bool": "boolean"}
    zero = {"string": "", "u64": 0, "i64": 0, "f32": 0.0, "f64": 0.0, "bool": False}
    parts = [(F.lit(None).cast("string") if t == "null" else F.coalesce(F.try_variant_get(v, f"$.{k}", kinds[t]), F.lit(zero[t]).cast(kinds[t]))).alias(k) for k, t in shape.items()]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def validate(shape_json: str) -> bool:
    """Whether a JSON text is a well-formed shape."""
    try:
        shape = json.loads(shape_json)
        if not isinstance(shape, dict):
            return False
        check_shape(shape)
    except (ValueError, TypeError):
        return False
    return True


def is_valid(shape_json: Column) -> Column:
    """validate() for each row of a column of JSON texts; null where there is none."""

    @F.pandas_udf("boolean")
    def valid(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else validate(t)).astype("boolean")

    return valid(shape_json)
