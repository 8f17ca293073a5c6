"""Shapes: inference, widening, defaults, validation; dictionaries and unions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import dictionary, reshape, shapes
from quarry.sources import codec


def test_infer_golden():
    value = {"a": 3, "b": -1, "c": [1, -1, 2.2, 3], "d": "s", "e": ["x"], "f": {"g": 1, "h": "t", "i": False, "j": {"a": None}}, "g": None, "h": False, "i": True, "j": [{"a": 1, "b": 2}, {"a": 3, "b": 4}]}
    assert codec.infer([value]) == {"a": "u64", "b": "i64", "c": ["f64"], "d": "string", "e": ["string"], "f": {"g": "u64", "h": "string", "i": "bool", "j": {"a": "null"}}, "g": "null", "h": "bool", "i": "bool", "j": [{"a": "u64", "b": "u64"}]}
    assert codec.infer([{"a": 1}, {"a": -1}, {"a": 0.5}]) == {"a": "f64"}
    assert codec.infer([{"a": 0.5}, {"a": 1}], last_wins=True) == {"a": "u64"}
    assert codec.infer([{"a": None}, {"a": "x"}, {"b": 1}]) == {"a": "string", "b": "u64"}


@pytest.mark.parametrize("bad", [["a", 1], [[1], [2]], [{"a": [1]}], [1, {"a": 1}]])
def test_arrays_that_have_no_shape(bad):
    with pytest.raises(ValueError):
        codec.infer([{"k": bad}])


@pytest.mark.parametrize(("shape", "good"), [({"a": "u64", "b": ["f64"], "c": {"d": "bool"}, "e": [{"f": "null"}]}, True), ({}, True), ({"a": "int"}, False), ({"a": [["u64"]]}, False), ({"a": [{"b": ["u64"]}]}, False), ({"a": []}, False), ([], False), ("u64", False), ({"a": ["u64", "u64"]}, False)])
def test_validate(shape, good):
    assert shapes.validate(json.dumps(shape)) is good
    assert shapes.validate("no json") is False


def test_infer_over_a_table(spark):
    rows = [{"a": 1, "b": "x", "c": [1, 2], "d": {"e": True}}, {"a": -1, "b": "y", "c": [0.5], "d": {"e": None, "f": 3}}, {"a": 2, "g": None}, {"a": "text"}]
    df = spark.createDataFrame([(i // 3, i, json.dumps(r)) for i, r in enumerate(rows)], "k int, ord int, props string")
    paths = shapes.typed_paths(df, "props", ["k"])
    got = {(r.k, r.path): r.type for r in shapes.infer(paths, ["k"]).collect()}
    assert got == {(0, "a"): "i64", (0, "b"): "string", (0, "c[]"): "f64", (0, "d.e"): "bool", (0, "d.f"): "u64", (0, "g"): "null", (1, "a"): "string"}
    last = {r.path: r.type for r in shapes.infer_last(shapes.typed_paths(df.withColumn("k", F.lit(0)), "props", ["k", "ord"], depth=1), ["k"], "ord").collect()}
    assert last["a"] == "string"


def test_widen_array(spark):
    df = spark.createDataFrame([(["u64", "u64"],), (["u64", "f32"],), (["i64", "u64", "f64"],), ([],)], "t array<string>")
    assert [r.w for r in df.select(shapes.widen_array(F.col("t")).alias("w")).collect()] == ["u64", "f32", "f64", None]
    with pytest.raises(Exception, match="must be the same"):
        spark.createDataFrame([(["u64", "string"],)], "t array<string>").select(shapes.widen_array(F.col("t"))).collect()


def test_defaults(spark):
    df = spark.createDataFrame([('{"a": 5, "x": 1}',), ("{}",)], "p string")
    got = [json.loads(r.d) for r in df.select(shapes.with_defaults(F.col("p"), {"a": "i64", "b": "string", "c": "bool", "d": "null"}).alias("d")).collect()]
    assert got == [{"a": 5, "b": "", "c": False, "d": None}, {"a": 0, "b": "", "c": False, "d": None}]


def test_dictionary(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate(["b", "a", "b", "c", "b", "a"])], "k string, v string, i int")
    d = dictionary.build(df, ["k"], "v", "i")
    assert {r.v: (r.idx, r["count"]) for r in d.collect()} == {"b": (0, 3), "a": (1, 2), "c": (2, 1)}
    assert {r.v: r.idx for r in dictionary.by_frequency(d, ["k"], "v").collect()} == {"b": 0, "a": 1, "c": 2}
    coded = spark.createDataFrame([("k", 2), ("k", 0), ("k", 9)], "k string, idx bigint")
    for limit in (0, 10):  # both joins
        assert sorted(((r.idx, r.v) for r in dictionary.lookup(coded, d, ["k"], "idx", "v", limit).collect()), key=str) == [(0, "b"), (2, "c"), (9, None)]


def test_layer_union_and_order(spark):
    a = spark.createDataFrame([("t", "x", 0, 1), ("t", "y", 1, 2)], "tile_id string, layer string, layer_ord int, n int")
    b = spark.createDataFrame([("t", "x", 0, 9)], "tile_id string, layer string, layer_ord int, n int")
    assert {(r.layer, r.n) for r in reshape.layer_union(a, b).collect()} == {("x", 9), ("y", 2)}
    f = spark.createDataFrame([(0, 3), (1, 1), (2, 3), (3, 1)], "fid int, type int").withColumn("k", F.lit("l"))
    assert [r.fid for r in reshape.stable_by_type(f, ["k"]).orderBy("position").collect()] == [1, 3, 0, 2]


GEOMETRY = "array<array<array<struct<x:bigint,y:bigint,z:bigint,m:string>>>>"


def test_reshape(spark):
    p = lambda x, y, z=None, m=None: {"x": x, "y": y, "z": z, "m": m}
    ring = [p(0, 0), p(4, 0), p(4, 4), p(0, 0)]
    df = spark.createDataFrame([(3, [[ring, ring], [ring]], [[0.0, 1.0], [2.0]]), (1, [[[p(1, 2, None, '{"a":1}'), p(3, 4)]]], None), (5, [[[p(1, 2, 3), p(4, 5, 6)]]], [[0.0]])], f"type int, geometry {GEOMETRY}, offsets array<array<double>>")
    t, g, o = F.col("type"), F.col("geometry"), F.col("offsets")
    got = df.select(F.size(reshape.load_points(t, g)).alias("n"), F.size(reshape.load_points(t, g, True)).alias("open"), reshape.load_lines(t, g, o).alias("lines"), reshape.load_polys(t, g, o).alias("polys"), reshape.load_flat(t, g, F.lit(4)).alias("flat"), reshape.m_values(g).alias("m"), reshape.has_offsets(o).alias("off"), reshape.geo_type(t).alias("geo"), reshape.is_single(t, g).alias("single")).collect()
    assert [(r.n, r.open, r.off, r.geo, r.single) for r in got] == [(12, 9, True, "MultiPolygon", False), (2, 2, False, "MultiPoint", False), (2, 2, False, "MultiLineString", True)]
    assert [x.offset for x in got[0].lines] == [0.0, 1.0, 2.0] and got[1].lines is None and got[1].polys is None and got[2].polys is None
    assert [len(x) for x in got[0].polys] == [2, 1]
    assert got[2].flat == [0.25, 0.5, 0.75, 1.0, 1.25, 1.5] and got[1].flat == [0.25, 0.5, 0.75, 1.0]
    assert got[1].m == ['{"a":1}', "{}"] and got[0].m is None


def test_unit_square_keeps_m(spark):
    df = spark.createDataFrame([("LineString", False, '[{"x":0.5,"y":0.25,"m":{"a":1}},{"x":1,"y":0}]'), ("Point", True, '{"x":0.1,"y":0.2}'), ("MultiPolygon", False, '[[[{"x":0,"y":1}]]]')], "k string, d boolean, c string")
    g = df.select(reshape.unit_type(F.col("k"), F.col("d")).alias("t"), reshape.unit_geometry(F.col("k"), F.col("c")).alias("g")).select("t", reshape.from_unit_square(F.col("t"), F.col("g"), F.lit(4096)).alias("g")).collect()
    assert [r.t for r in g] == [2, 4, 3]
    assert [(v.x, v.y, v.m) for v in g[0].g[0][0]] == [(2048, 1024, '{"a":1}'), (4096, 0, None)]
    assert tuple(g[1].g[0][0][0])[:3] == (410, 819, 0)


def test_event_windows_and_sessions(spark):
    from quarry.streaming.tiles import sessions, windowed_counts

    e = spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1L AS user_id, 2.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:20:00', 'a', 1L, 3.0D UNION ALL SELECT TIMESTAMP '2024-01-01 03:00:00', 'a', 1L, 1.0D")
    assert sorted((r.n, r.total) for r in windowed_counts(e).collect()) == [(1, 1.0), (2, 5.0)]
    assert sorted(r.n for r in sessions(e).collect()) == [1, 2]
