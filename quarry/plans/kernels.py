"""Queries of the scalar and array kernels, each held against SQL that computes the same another way."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, bits
from ..functions import sql as sqlfuncs
from .derive import POINTS_SQL, RINGS_SQL, points, rings, table
from .registry import query

KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def zz(expr: str) -> str:
    return f"CASE WHEN ({expr}) >= 0 THEN 2 * ({expr}) ELSE -2 * ({expr}) - 1 END"


def woven(*parts: str) -> str:
    """SQL of numbers interleaved bit by bit: a sum over sixteen bits."""
    n = len(parts)
    return " + ".join(f"((({p}) >> {i}) & 1) * {1 << (n * i + k)}" for k, p in enumerate(parts) for i in range(16))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT) * 8 + l_linenumber % 8 AS encoded FROM lineitem")
def command_encode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.command_encode(F.col("l_linenumber"), F.col("l_quantity")).alias("encoded"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_partkey % 8 AS BIGINT) AS cmd, CAST(l_partkey // 8 AS BIGINT) AS length FROM lineitem")
def command_decode(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.command_decode(F.col("l_partkey")).alias("c")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "c.*")


@query(f"SELECT {KEYS}, {zz('l_partkey - 1000')} AS zz, l_partkey - 1000 AS back FROM lineitem")
def zigzag_roundtrip(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("v", F.col("l_partkey") - 1000)
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.zigzag("v").alias("zz"), bits.zagzig(bits.zigzag("v")).alias("back"))


@query(f"SELECT {KEYS}, CASE WHEN l_partkey % 2 = 0 THEN l_partkey // 2 ELSE -(l_partkey + 1) // 2 END AS v FROM lineitem")
def zagzig(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.zagzig("l_partkey").alias("v"))


@query(f"WITH {POINTS_SQL} SELECT {KEYS}, CAST({woven('x', 'y')} AS BIGINT) AS w FROM p")
def weave2d(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.weave2d("x", "y").alias("w"))


@query(f"WITH {POINTS_SQL} SELECT {KEYS}, x AS a, y AS b FROM p")
def unweave2d(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.unweave2d(bits.weave2d("x", "y")).alias("u")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "u.*")


@query(f"WITH {POINTS_SQL} SELECT {KEYS}, CAST({woven('x', 'y', 'z')} AS BIGINT) AS w FROM p")
def weave3d(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.weave3d("x", "y", "z").alias("w"))


@query(f"WITH {POINTS_SQL} SELECT {KEYS}, x AS a, y AS b, z AS c FROM p")
def unweave3d(spark, sf_dir):
    return points(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", bits.unweave3d(bits.weave3d("x", "y", "z")).alias("u")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "u.*")


BOX = "lon AS (SELECT c_custkey, (c_custkey * 7919 % 360000) / 1000.0::DOUBLE - 180 AS lon, (c_custkey * 104729 % 180000) / 1000.0::DOUBLE - 90 AS lat FROM customer)"


def boxes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.withColumn("lon", (F.col("c_custkey") * 7919 % 360000) / F.lit(1000.0) - 180).withColumn("lat", (F.col("c_custkey") * 104729 % 180000) / F.lit(1000.0) - 90)


@query(f"WITH {BOX} SELECT c_custkey, CAST(floor((lon + 180) * 16777215 / 360 + 0.5) AS BIGINT) AS qlon, CAST(floor((lat + 90) * 16777215 / 180 + 0.5) AS BIGINT) AS qlat FROM lon")
def quantize_lonlat(spark, sf_dir):
    return boxes(spark, sf_dir).select("c_custkey", bits.quantize_lon("lon").alias("qlon"), bits.quantize_lat("lat").alias("qlat"))


@query("SELECT c_custkey, CAST(floor((c_custkey * 9973 % 16777216 * 360.0::DOUBLE / 16777215 - 180) * 1000000) AS BIGINT) AS lon_e6, CAST(floor((c_custkey * 7919 % 16777216 * 180.0::DOUBLE / 16777215 - 90) * 1000000) AS BIGINT) AS lat_e6 FROM customer")
def dequantize_lonlat(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    e6 = lambda v: F.floor(v * 1000000).cast("bigint")
    return c.select("c_custkey", e6(bits.dequantize_lon(F.col("c_custkey") * 9973 % 16777216)).alias("lon_e6"), e6(bits.dequantize_lat(F.col("c_custkey") * 7919 % 16777216)).alias("lat_e6"))


def hex6(expr: str) -> str:
    return f"lpad(upper(to_hex({expr})), 6, '0')"


@query(f"WITH {BOX}, q AS (SELECT c_custkey, CAST(floor((lon + 180) * 16777215 / 360 + 0.5) AS BIGINT) AS qlon, CAST(floor((lat + 90) * 16777215 / 180 + 0.5) AS BIGINT) AS qlat FROM lon) SELECT c_custkey, {hex6('qlon')} || {hex6('qlat')} || {hex6('qlon')} || {hex6('qlat')} AS packed, qlon AS west, qlat AS south FROM q")
def bbox_pack(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("b", F.struct(F.col("lon").alias("left"), F.col("lat").alias("bottom"), F.col("lon").alias("right"), F.col("lat").alias("top")))
    b = b.withColumn("data", arrays.quantize_bbox(F.col("b")))
    return b.select("c_custkey", F.hex("data").alias("packed"), bits.unpack24(F.col("data"), 1).alias("west"), bits.unpack24(F.col("data"), 4).alias("south"))


@query(f"WITH {BOX}, q AS (SELECT c_custkey, CAST(floor((lon + 180) * 16777215 / 360 + 0.5) AS BIGINT) AS qlon, CAST(floor((lat + 90) * 16777215 / 180 + 0.5) AS BIGINT) AS qlat FROM lon) SELECT c_custkey, CAST(floor((qlon * 360.0::DOUBLE / 16777215 - 180) * 1000000) AS BIGINT) AS west_e6, CAST(floor((qlat * 180.0::DOUBLE / 16777215 - 90) * 1000000) AS BIGINT) AS north_e6, CAST(c_custkey % 1000 AS BIGINT) AS near, -CAST(c_custkey % 77 AS BIGINT) AS far FROM q")
def bbox_unpack(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("b", F.struct(F.col("lon").alias("left"), F.col("lat").alias("bottom"), F.col("lon").alias("right"), F.col("lat").alias("top"), (F.col("c_custkey") % 1000).cast("double").alias("near"), (-(F.col("c_custkey") % 77)).cast("double").alias("far")))
    b = b.withColumn("data", arrays.quantize_bbox(F.col("b"), three=True)).withColumn("d", arrays.dequantize_bbox(F.col("data")))
    e6 = lambda c: F.floor(F.col(c) * 1000000).cast("bigint")
    return b.select("c_custkey", e6("d.left").alias("west_e6"), e6("d.top").alias("north_e6"), F.col("d.near").cast("bigint").alias("near"), F.col("d.far").cast("bigint").alias("far"))


@query("SELECT p_partkey, CAST(floor(p_retailprice::FLOAT::DOUBLE * 4096) AS BIGINT) AS back FROM part")
def float_pack(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("data", bits.pack_float(F.col("p_retailprice")))
    return p.select("p_partkey", F.floor(bits.unpack_float(F.col("data")) * 4096).cast("bigint").alias("back"))


@query(f"SELECT {KEYS}, CAST(floor(CAST(l_quantity AS DOUBLE) / 8 * 1000) AS BIGINT) AS fixed, floor(CAST(l_quantity AS DOUBLE) / 8 * 1000) / 1000 AS back FROM lineitem")
def offset_fixed(spark, sf_dir):
    fixed = bits.encode_offset(F.col("l_quantity").cast("double") / 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", fixed.alias("fixed"), bits.decode_offset(fixed).alias("back"))


@query("SELECT o_orderkey, CAST(o_orderkey % 6 AS INT) AS code, CAST(512 * pow(2, o_orderkey % 6) AS INT) AS extent FROM orders")
def extent_code(spark, sf_dir):
    extent = bits.decode_extent((F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.encode_extent(extent).alias("code"), extent.alias("extent"))


@query("SELECT o_orderkey, CAST((o_orderkey % 1000) * 4 + o_orderkey % 3 AS BIGINT) AS attribute, CAST(o_orderkey % 3 AS BIGINT) AS kind, CAST(o_orderkey % 1000 AS BIGINT) AS count FROM orders")
def attribute_code(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("attribute", bits.encode_attribute(F.col("o_orderkey") % 3, F.col("o_orderkey") % 1000))
    return o.withColumn("d", bits.decode_attribute(F.col("attribute"))).select("o_orderkey", "attribute", "d.kind", "d.count")


@query("SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS INT) AS code, (['string', 'u64', 'i64', 'f32', 'f64', 'bool', 'null'])[o_orderkey % 7 + 1] AS name FROM orders")
def shape_type_code(spark, sf_dir):
    name = bits.shape_type_name((F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.shape_type_code(name).alias("code"), name.alias("name"))


@query("SELECT o_orderkey, CAST(o_orderkey % 9 AS INT) AS code, (['png', 'jpg', 'webp', 'gif', 'avif', 'svg', 'bmp', 'raw', 'unknown'])[o_orderkey % 9 + 1] AS name FROM orders")
def image_type_code(spark, sf_dir):
    name = bits.image_type_name((F.col("o_orderkey") % 9).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.image_type_code(name).alias("code"), name.alias("name"))


def rgb():
    return F.col("p_partkey") % 256, F.col("p_size") * 5 % 256, F.col("p_partkey") * 3 % 256


@query("SELECT p_partkey, (p_partkey % 256) * 256.0::DOUBLE + (p_size * 5 % 256) + (p_partkey * 3 % 256) / 256.0::DOUBLE - 32768 AS elevation FROM part")
def elevation_terrarium(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bits.elevation_terrarium(*rgb()).alias("elevation"))


@query("SELECT p_partkey, CAST(((p_partkey % 256) * 65536 + (p_size * 5 % 256) * 256 + (p_partkey * 3 % 256)) - 100000 AS BIGINT) AS decimetres FROM part")
def elevation_rgb(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(bits.elevation_rgb(*rgb()) * 10).cast("bigint").alias("decimetres"))


@query("SELECT c_custkey, CAST(floor((c_custkey % 1009) / 1009.0::DOUBLE * 4096 + 0.5) AS BIGINT) AS x, CAST(floor((c_custkey % 787) / 787.0::DOUBLE * 4096 + 0.5) AS BIGINT) AS y, 0::BIGINT AS z FROM customer")
def transform_point(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = bits.transform_point(F.col("c_custkey") % 1009 / F.lit(1009.0), F.col("c_custkey") % 787 / F.lit(787.0), F.lit(None).cast("double"), 4096)
    return c.select("c_custkey", p.alias("p")).select("c_custkey", "p.*")


@query(f"SELECT {KEYS}, {zz('l_partkey - 500')} AS zz, CAST((l_partkey % 256) * 256.0::DOUBLE - 32768 AS BIGINT) AS low FROM lineitem")
def sql_functions(spark, sf_dir):
    sqlfuncs.register(spark)
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("quarry_lineitem")
    return spark.sql(f"SELECT {KEYS}, tile_zigzag(l_partkey - 500) AS zz, CAST(tile_elevation_terrarium(l_partkey % 256, 0, 0) AS BIGINT) AS low FROM quarry_lineitem")


# Arrays and rows

LAG = "lag({0}, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY pos)"


@query(f"WITH {POINTS_SQL}, d AS (SELECT *, x - {LAG.format('x')} AS dx FROM p) SELECT {KEYS}, {zz('dx')} AS delta, x AS back FROM d")
def delta_rows(spark, sf_dir):
    d = arrays.delta_encode_rows(points(spark, sf_dir), ["l_orderkey"], ["pos"], "x", "delta")
    return arrays.delta_decode_rows(d, ["l_orderkey"], ["pos"], "delta", "back").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "delta", "back")


@query(f"WITH {POINTS_SQL}, s AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x, pos) - 1 AS k FROM p) SELECT l_orderkey, k, x - lag(x, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY k) AS delta, x AS back FROM s")
def delta_sorted(spark, sf_dir):
    from pyspark.sql import Window as W

    p = points(spark, sf_dir).withColumn("k", (F.row_number().over(W.partitionBy("l_orderkey").orderBy("x", "pos")) - 1).cast("bigint"))
    d = arrays.delta_encode_rows(p, ["l_orderkey"], ["k"], "x", "delta", sort=True)
    return arrays.delta_decode_rows(d, ["l_orderkey"], ["k"], "delta", "back", sort=True).select("l_orderkey", "k", "delta", "back")


def order_arrays(spark, sf_dir):
    v = F.struct("pos", "x", "y", "z")
    return points(spark, sf_dir).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(v)), lambda e: F.struct(e.x.alias("x"), e.y.alias("y"), e.z.alias("z"))).alias("pts"))


@query(f"WITH {POINTS_SQL}, d AS (SELECT l_orderkey, pos, x, x - {LAG.format('x')} AS dx FROM p) SELECT l_orderkey, string_agg(CAST({zz('dx')} AS VARCHAR), ',' ORDER BY pos) AS encoded, string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos) AS decoded FROM d GROUP BY l_orderkey")
def delta_arrays(spark, sf_dir):
    a = order_arrays(spark, sf_dir).withColumn("x", F.transform("pts", lambda p: p.x)).withColumn("e", arrays.delta_encode(F.col("x")))
    return a.select("l_orderkey", F.concat_ws(",", F.col("e").cast("array<string>")).alias("encoded"), F.concat_ws(",", arrays.delta_decode(F.col("e")).cast("array<string>")).alias("decoded"))


@query(f"WITH {POINTS_SQL}, s AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS k FROM p), d AS (SELECT l_orderkey, k, x, x - lag(x, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY k) AS dx FROM s) SELECT l_orderkey, string_agg(CAST(dx AS VARCHAR), ',' ORDER BY k) AS encoded, string_agg(CAST(x AS VARCHAR), ',' ORDER BY k) AS decoded FROM d GROUP BY l_orderkey")
def delta_sorted_arrays(spark, sf_dir):
    a = order_arrays(spark, sf_dir).withColumn("x", F.array_sort(F.transform("pts", lambda p: p.x))).withColumn("e", arrays.delta_encode_sorted(F.col("x")))
    return a.select("l_orderkey", F.concat_ws(",", F.col("e").cast("array<string>")).alias("encoded"), F.concat_ws(",", arrays.delta_decode_sorted(F.col("e")).cast("array<string>")).alias("decoded"))


_STEPS = f"WITH {POINTS_SQL}, d AS (SELECT l_orderkey, pos, x, y, z, x - {LAG.format('x')} AS dx, y - {LAG.format('y')} AS dy, z - {LAG.format('z')} AS dz FROM p), e AS (SELECT *, {zz('dx')} AS ex, {zz('dy')} AS ey, {zz('dz')} AS ez FROM d)"


@query(f"{_STEPS} SELECT l_orderkey, string_agg(CAST(CAST({woven('ex', 'ey')} AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS encoded FROM e GROUP BY l_orderkey")
def weave_delta_2d(spark, sf_dir):
    return order_arrays(spark, sf_dir).select("l_orderkey", F.concat_ws(",", arrays.weave_delta_encode(F.col("pts")).cast("array<string>")).alias("encoded"))


@query(f"WITH {POINTS_SQL} SELECT l_orderkey, string_agg(x || ':' || y, ',' ORDER BY pos) AS decoded FROM p GROUP BY l_orderkey")
def unweave_delta_2d(spark, sf_dir):
    back = arrays.unweave_delta_decode(F.col("e"))
    a = order_arrays(spark, sf_dir).select("l_orderkey", arrays.weave_delta_encode(F.col("pts")).alias("e"))
    return a.select("l_orderkey", F.concat_ws(",", F.transform(back, lambda p: F.concat_ws(":", p.x.cast("string"), p.y.cast("string")))).alias("decoded"))


@query(f"{_STEPS} SELECT l_orderkey, string_agg(CAST(CAST({woven('ex', 'ey', 'ez')} AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS encoded FROM e GROUP BY l_orderkey")
def weave_delta_3d(spark, sf_dir):
    return order_arrays(spark, sf_dir).select("l_orderkey", F.concat_ws(",", arrays.weave_delta_encode_3d(F.col("pts")).cast("array<string>")).alias("encoded"))


@query(f"WITH {POINTS_SQL} SELECT l_orderkey, string_agg(x || ':' || y || ':' || z, ',' ORDER BY pos) AS decoded FROM p GROUP BY l_orderkey")
def unweave_delta_3d(spark, sf_dir):
    back = arrays.unweave_delta_decode_3d(F.col("e"))
    a = order_arrays(spark, sf_dir).select("l_orderkey", arrays.weave_delta_encode_3d(F.col("pts")).alias("e"))
    return a.select("l_orderkey", F.concat_ws(",", F.transform(back, lambda p: F.concat_ws(":", p.x.cast("string"), p.y.cast("string"), p.z.cast("string")))).alias("decoded"))


@query(f"WITH {POINTS_SQL}, t AS (SELECT l_orderkey, (pos // 2) AS k, pos % 2 AS odd, x FROM p), n AS (SELECT l_orderkey FROM p GROUP BY l_orderkey HAVING count(*) % 2 = 0) SELECT l_orderkey, string_agg(s, ',' ORDER BY k) AS tessellation FROM (SELECT l_orderkey, k, max(x) FILTER (odd = 0) || ':' || max(x) FILTER (odd = 1) AS s FROM t JOIN n USING (l_orderkey) GROUP BY l_orderkey, k) GROUP BY l_orderkey")
def fix_tessellation(spark, sf_dir):
    a = order_arrays(spark, sf_dir).where(F.size("pts") % 2 == 0).select("l_orderkey", arrays.fix_tessellation(F.transform("pts", lambda p: p.x)).alias("t"))
    return a.select("l_orderkey", F.concat_ws(",", F.transform("t", lambda p: F.concat_ws(":", p.x.cast("string"), p.y.cast("string")))).alias("tessellation"))


@query(f"WITH {RINGS_SQL} SELECT p_partkey, CAST(CASE WHEN odd THEN -2 * s * s ELSE 2 * s * s END AS BIGINT) AS area2 FROM r")
def ring_area(spark, sf_dir):
    return rings(spark, sf_dir).select("p_partkey", arrays.signed_area(F.col("ring")).alias("area2"))


_CLASSIFY = f"WITH {RINGS_SQL}, s AS (SELECT p_brand, p_partkey, odd FROM r WHERE s > 0), f AS (SELECT *, first_value(odd) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS outer_odd FROM s)"


@query(f"{_CLASSIFY} SELECT p_brand, p_partkey, CAST(sum(CASE WHEN odd = outer_odd THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS poly FROM f")
def classify_rings_rows(spark, sf_dir):
    r = rings(spark, sf_dir).withColumn("area", arrays.signed_area(F.col("ring")))
    return arrays.classify_rings_rows(r, ["p_brand"], "p_partkey", "area", "poly").select("p_brand", "p_partkey", "poly")


@query(f"WITH {RINGS_SQL}, g AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) // 10 AS grp FROM r), s AS (SELECT * FROM g WHERE s > 0), f AS (SELECT *, first_value(odd) OVER (PARTITION BY p_brand, grp ORDER BY p_partkey) AS outer_odd FROM s) SELECT p_brand, CAST(grp AS INT) AS grp, CAST(CASE WHEN n = 1 THEN 1 ELSE polys END AS INT) AS n_polys, CAST(CASE WHEN n = 1 THEN n ELSE rings END AS INT) AS n_rings FROM (SELECT p_brand, grp, count(*) AS rings, count(*) FILTER (odd = outer_odd) AS polys FROM f GROUP BY p_brand, grp) JOIN (SELECT p_brand, grp, count(*) AS n FROM g GROUP BY p_brand, grp) USING (p_brand, grp)")
def classify_rings(spark, sf_dir):
    from .derive import polygon_features

    g = polygon_features(spark, sf_dir).withColumn("polys", arrays.classify_rings(F.col("rings")))
    return g.select("p_brand", "grp", F.size("polys").alias("n_polys"), F.size(F.flatten("polys")).alias("n_rings"))


@query("WITH m AS (SELECT vec_id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, CAST(floor((v - low) * 8192 / (high - low) + 0.5) AS BIGINT) AS mapped FROM m")
def grid_remap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.array_min("embedding").cast("double").alias("low"), F.array_max("embedding").cast("double").alias("high"), F.posexplode("embedding").alias("i", "v"))
    return e.select("vec_id", "i", arrays.remap(F.col("v").cast("double"), F.col("low"), F.col("high"), 8192).alias("mapped"))


@query("WITH m AS (SELECT vec_id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings) SELECT vec_id, CAST(i AS INT) AS i, CAST(floor((v - low) * 8192 / (high - low) + 0.5) AS BIGINT) AS mapped, TRUE AS near FROM m")
def grid_unmap(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("d")).withColumn("g", arrays.grid_encode(F.col("d"), 8192))
    back = arrays.grid_decode(F.col("g.data"), F.col("g.min"), F.col("g.max"), 8192)
    e = e.select("vec_id", (F.col("g.max") - F.col("g.min")).alias("span"), F.posexplode(F.arrays_zip(F.col("d"), back.alias("b"), arrays.delta_decode(F.col("g.data")).alias("mapped"))).alias("i", "z"))
    return e.select("vec_id", "i", "z.mapped", (F.abs(F.col("z.b") - F.col("z.d")) <= F.col("span") / 8192).alias("near"))


@query("SELECT vec_id, list_min(embedding)::DOUBLE AS low, list_max(embedding)::DOUBLE AS high, least(0, list_min(embedding)::DOUBLE) AS low_from_zero FROM embeddings")
def grid_minmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("d", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", F.array_min("d").alias("low"), F.array_max("d").alias("high"), arrays.grid_encode(F.col("d"), 8192, from_zero=True).min.alias("low_from_zero"))
