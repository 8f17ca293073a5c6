"""Geometry derived from the relational tables, in whole numbers, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Orders of a tile: ranges of keys, so tiles keep their size when tables grow.
SPAN = 1024
VERTEX_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tile_of(key: str):
    return F.floor(F.col(key) / SPAN).cast("string")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per line item: its keys, pos (its place within its order), x, y, z."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    x, y = (F.col("l_partkey") * 37 + F.col("l_linenumber") * 11) % 4096, (F.col("l_suppkey") * 41 + F.col("l_orderkey")) % 4096
    pos = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*VERTEX_ORDER)) - 1
    return li.withColumn("x", x).withColumn("y", y).withColumn("z", (F.col("l_quantity").cast("bigint") * 3) % 512).withColumn("pos", pos.cast("bigint"))


POINTS_SQL = """p AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity,
    (l_partkey * 37 + l_linenumber * 11) % 4096 AS x, (l_suppkey * 41 + l_orderkey) % 4096 AS y, (CAST(l_quantity AS BIGINT) * 3) % 512 AS z,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle per part, its winding by the parity of the key; every 97th part gives a ring without area."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    x, y, s = F.col("p_partkey") * 7 % 3000, F.col("p_partkey") * 13 % 3000, F.when(F.col("p_partkey") % 97 == 0, 0).otherwise(F.col("p_size")).cast("bigint")
    at = lambda dx, dy: F.struct((x + dx).cast("bigint").alias("x"), (y + dy).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("z"), F.lit(None).cast("string").alias("m"))
    zero = F.lit(0).cast("bigint")
    one, other = [at(zero, zero), at(s, zero), at(s, s), at(zero, s), at(zero, zero)], [at(zero, zero), at(zero, s), at(s, s), at(s, zero), at(zero, zero)]
    return p.withColumn("ring", F.when(F.col("p_partkey") % 2 == 1, F.array(*other)).otherwise(F.array(*one)))


#: Twice the signed area of a part's ring is 2 s s, its sign by the winding.
RINGS_SQL = "r AS (SELECT p_partkey, p_brand, p_partkey * 7 % 3000 AS x, p_partkey * 13 % 3000 AS y, CAST(CASE WHEN p_partkey % 97 = 0 THEN 0 ELSE p_size END AS BIGINT) AS s, p_partkey % 2 = 1 AS odd FROM part)"


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per order (of two vertices at least) with an offset and m-values, in tiles by ranges of orders."""
    p = points(spark, sf_dir)
    v = F.struct("pos", F.struct("x", "y", F.lit(None).cast("bigint").alias("z"), F.to_json(F.struct(F.col("l_quantity").cast("bigint").alias("q"))).alias("m")).alias("v"))
    lines = p.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(v)), lambda e: e.v).alias("line")).where(F.size("line") > 1)
    return lines.select(tile_of("l_orderkey").alias("tile_id"), F.lit("orders").alias("layer"), F.col("l_orderkey").cast("int").alias("fid"), F.col("l_orderkey").cast("decimal(20,0)").alias("id"), F.lit(2).alias("type"), F.lit(4096).alias("extent"), F.to_json(F.struct(F.col("l_orderkey").alias("k"), F.size("line").alias("n"))).alias("properties"), F.array(F.array("line")).alias("geometry"), F.array(F.array((F.col("l_orderkey") % 50).cast("double") / 4)).alias("offsets"))


def polygon_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature per ten parts of a brand: their rings in order of key, not yet grouped to polygons."""
    r = rings(spark, sf_dir)
    n = F.floor((F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1) / 10).cast("int")
    g = r.withColumn("grp", n).groupBy("p_brand", "grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "ring"))), lambda e: e.ring).alias("rings"))
    return g
