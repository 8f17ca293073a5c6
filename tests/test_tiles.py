"""Tiles: literal bytes, round trips of all kinds, an independent decoder, the source in batch, stream and SQL."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import encode, reshape
from quarry.sources import codec, tiles, wire


def pt(x, y, z=None, m=None):
    return (x, y, z, m)


def feature(kind, geometry, **more):
    return {"id": None, "type": kind, "properties": {}, "geometry": geometry, "offsets": None, "bbox": None, "indices": None, "tessellation": None} | more


def back(data):
    return codec.read_tile(data)


ALL = {"a": -3, "b": 2**40, "c": 0.5, "d": 0.1, "e": True, "f": None, "g": "text", "h": ["x", "y"], "i": {"j": 1.25, "k": False, "l": None}}
SHAPE = {"a": "i64", "b": "u64", "c": "f32", "d": "f64", "e": "bool", "f": "null", "g": "string", "h": ["string"], "i": {"j": "f64", "k": "bool", "l": "null"}}


def test_columnar_all_values_and_all_types():
    line, other = [pt(0, 0), pt(5, 7), pt(-3, 100)], [pt(9, 9), pt(10, 9)]
    ring, hole = [pt(0, 0), pt(10, 0), pt(10, 10), pt(0, 0)], [pt(2, 2), pt(2, 4), pt(4, 4), pt(2, 2)]
    up = lambda r: [(x, y, i, m) for i, (x, y, _, m) in enumerate(r)]
    features = [
        feature(1, [[[pt(4096, 33)]]], id=7, properties=ALL), feature(1, [[line]], id=2**63 + 5, properties=ALL),
        feature(2, [[line]], offsets=[[1.5]]), feature(2, [[line, other]], offsets=[[0.0, 2.25]]),
        feature(3, [[ring, hole]], indices=[0, 1, 2, 2, 1], tessellation=[(1, 2, None), (3, 4, None)], bbox=[-10.0, -20.0, 30.0, 40.0]),
        feature(3, [[ring, hole], [ring]], offsets=[[0.0, 1.0], [2.0]]),
        feature(4, [[[pt(1, 2, 3)]]]), feature(4, [[up(line)]]), feature(5, [[up(line), up(other)]]),
        feature(6, [[up(ring)], [up(ring), up(hole)]], tessellation=[(1, 2, 3)], bbox=[0.0, 0.0, 1.0, 1.0, -5.5, 100.25]),
    ]
    for f in features[2:]:
        f["properties"] = {"a": 1}
    layer = {"layer": "all", "extent": 8192, "shape": SHAPE, "mshape": None, "features": features}
    got = back(codec.write_tile([layer]))["layers"]
    assert len(got) == 1
    out = got[0]["features"]
    assert (got[0]["extent"], got[0]["shape"], got[0]["kind"]) == (8192, SHAPE, "open")
    assert [f["type"] for f in out] == sorted(f["type"] for f in features)
    for f, g in zip(sorted(features, key=lambda f: f["type"]), out):
        assert g["geometry"] == f["geometry"] and g["id"] == f["id"] and g["indices"] == f["indices"] and g["tessellation"] == f["tessellation"]
        if f["offsets"]:
            assert g["offsets"] == f["offsets"]
        if f["bbox"]:
            assert g["bbox"] == pytest.approx(f["bbox"], abs=3e-5)
    assert out[0]["properties"] == ALL


def test_missing_values_get_defaults():
    layer = {"layer": "x", "extent": 512, "shape": SHAPE, "mshape": None, "features": [feature(1, [[[pt(0, 0)]]], properties={"extra": 1})]}
    got = back(codec.write_tile([layer]))["layers"][0]["features"][0]["properties"]
    assert got == {"a": 0, "b": 0, "c": 0.0, "d": 0.0, "e": False, "f": None, "g": "", "h": [], "i": {"j": 0.0, "k": False, "l": None}}


def test_m_values_follow_vertices():
    line = [pt(1, 1, None, {"size": 4}), pt(2, 2), pt(3, 3, None, {"size": -1})]
    layer = {"layer": "m", "extent": 4096, "shape": {"n": "string"}, "mshape": {"size": "i64"}, "features": [feature(2, [[line]]), feature(1, [[line]]), feature(3, [[[*line, line[0]]]])]}
    for f in back(codec.write_tile([layer]))["layers"][0]["features"]:
        assert [p[3]["size"] for p in f["geometry"][0][0]][:3] == [4, 0, -1]


def test_wide_steps_and_negative_offsets_are_errors():
    for f in (feature(1, [[[pt(40000, 0)]]]), feature(2, [[[pt(0, 0), pt(40000, 0)]]]), feature(2, [[[pt(0, 0)]]], offsets=[[1.0, -2.0]]) | {"geometry": [[[pt(0, 0)], [pt(1, 1)]]]}):
        with pytest.raises(ValueError, match="16 bits|negative"):
            codec.write_tile([{"layer": "w", "extent": 4096, "shape": {}, "features": [f]}])


def test_numeric_columns_are_ordered_by_use():
    c = codec.Columns()
    for v in (5, 9, 9, 2, 2, 7):
        c.refer(codec.U64, v)
    cache = codec.Cache(memoryview(c.write()))
    assert [cache.get(codec.U64, i) for i in range(4)] == [2, 9, 5, 7]


def test_cache_may_come_after_or_before_layers():
    data = codec.write_tile([{"layer": "o", "extent": 4096, "shape": {}, "features": [feature(1, [[[pt(3, 4)]]])]}])
    parts = [(tag, bytes(v)) for tag, _, v in wire.fields(memoryview(data))]
    out = bytearray()
    for tag, v in reversed(parts):
        wire.put_bytes(out, tag, v)
    wire.put(out, 99, 5)  # a tag nobody knows
    assert back(bytes(out))["layers"][0]["features"][0]["geometry"] == [[[pt(3, 4)]]]
    with pytest.raises(ValueError, match="no column cache"):
        only = bytearray()
        wire.put_bytes(only, codec.OPEN, dict(parts)[codec.OPEN])
        back(bytes(only))


def mvt_decode(data):
    """A second decoder, straight from the wire rules: layer name to list of (id, type, properties, paths)."""
    def fields_of(b):
        i, out = 0, []
        while i < len(b):
            key = shift = 0
            while True:
                c = b[i]; i += 1; key |= (c & 127) << shift; shift += 7  # noqa: E702
                if c < 128:
                    break
            if key & 7 == 2 or key & 7 == 0:
                n = shift = 0
                while True:
                    c = b[i]; i += 1; n |= (c & 127) << shift; shift += 7  # noqa: E702
                    if c < 128:
                        break
                if key & 7 == 2:
                    out.append((key >> 3, b[i : i + n])); i += n  # noqa: E702
                else:
                    out.append((key >> 3, n))
            else:
                n = 8 if key & 7 == 1 else 4
                out.append((key >> 3, b[i : i + n])); i += n  # noqa: E702
        return out

    def ints(b):
        out, n, s = [], 0, 0
        for c in b:
            n |= (c & 127) << s
            s += 7
            if c < 128:
                out.append(n)
                n = s = 0
        return out

    import struct

    layers = {}
    for tag, layer in fields_of(data):
        assert tag == 3
        f = fields_of(layer)
        keys = [v.decode() for t, v in f if t == 3]
        vals = []
        for t, v in f:
            if t == 4:
                [(k, x)] = fields_of(v)
                vals.append(x.decode() if k == 1 else struct.unpack("<d", x)[0] if k == 3 else bool(x) if k == 7 else (x >> 1) ^ -(x & 1) if k == 6 else x)
        feats = []
        for t, v in f:
            if t != 2:
                continue
            g = dict(fields_of(v))
            p = ints(g.get(2, b""))
            nums, i, x, y, paths = ints(g[4]), 0, 0, 0, []
            while i < len(nums):
                cmd, n = nums[i] & 7, nums[i] >> 3
                i += 1
                if cmd == 7:
                    paths[-1].append(paths[-1][0])
                    continue
                for _ in range(n):
                    x += (nums[i] >> 1) ^ -(nums[i] & 1)
                    y += (nums[i + 1] >> 1) ^ -(nums[i + 1] & 1)
                    i += 2
                    if cmd == 1:
                        paths.append([])
                    paths[-1].append((x, y))
            feats.append((g.get(1), g[3], {keys[a]: vals[b] for a, b in zip(p[::2], p[1::2])}, paths))
        layers[dict(f)[1].decode()] = feats
    return layers


def test_mvt_against_second_decoder():
    rng = random.Random(4)
    square = lambda x, y, s: [pt(x, y), pt(x + s, y), pt(x + s, y + s), pt(x, y + s), pt(x, y)]
    features = [feature(1, [[[pt(rng.randrange(4096), rng.randrange(4096)) for _ in range(3)]]], id=5, properties={"a": "x", "n": [0, 1, 2, 3], "t": True, "i": 1, "neg": -4, "d": 1.5})]
    features.append(feature(2, [[[pt(1, 2), pt(3, 4), pt(-5, 6)], [pt(9, 9), pt(8, 8)]]], properties={"a": "x"}))
    features.append(feature(3, [[square(0, 0, 10), list(reversed(square(2, 2, 3)))], [square(50, 50, 5)]]))
    [(name, got)] = mvt_decode(codec.write_tile([{"layer": "L", "extent": 8192, "features": features}], "mvt")).items()
    assert name == "L"
    assert got[0][2] == {"a": "x", "n": "[0,1,2,3]", "t": True, "i": 1, "neg": -4, "d": 1.5}
    for f, (ident, kind, _, paths) in zip(features, got):
        rings = [[(p[0], p[1]) for p in r] for poly in f["geometry"] for r in poly]
        assert (ident, kind) == (f["id"], f["type"])
        assert paths == ([[p] for p in rings[0]] if kind == 1 else rings)


@pytest.mark.parametrize("kind", ["mvt", "flat"])
def test_row_format_round_trip(kind):
    square = [pt(0, 0), pt(10, 0), pt(10, 10), pt(0, 10), pt(0, 0)]
    hole = [pt(2, 2), pt(2, 4), pt(4, 4), pt(4, 2), pt(2, 2)]
    features = [feature(3, [[square, hole], [square]], indices=[0, 1, 2, 9], tessellation=[(1, 2, None), (0, 9, None)], id=9), feature(1, [[[pt(5, 5)]]]), feature(2, [[[pt(0, 0), pt(1, 1)]]])]
    layer = back(codec.write_tile([{"layer": "r", "extent": 2048, "features": features}], kind))["layers"][0]
    assert (layer["extent"], layer["kind"]) == (2048, kind)
    for f, g in zip(features, layer["features"]):
        assert (g["geometry"], g["indices"], g["tessellation"], g["id"], g["type"]) == (f["geometry"], f["indices"], f["tessellation"], f["id"], f["type"])


def test_second_close_path_and_degenerate_rings():
    z = wire.zigzag
    square = [9, z(0), z(0), 26, z(10), z(0), z(0), z(10), z(-10), z(0), 15]
    assert codec.commands([*square, 15], 3, False) == codec.commands(square, 3, False)
    flat = [9, z(0), z(0), 18, z(5), z(5), z(5), z(5), 15]
    assert len(codec.commands(flat + flat, 3, False)) == 1
    with pytest.raises(ValueError, match="unknown geometry command"):
        codec.commands([3], 1, False)


def test_empty_layers_and_last_name_wins():
    a = codec.write_tile([{"layer": "x", "extent": 512, "features": []}, {"layer": "y", "extent": 512, "features": [feature(1, [[[pt(1, 1)]]])]}], "mvt")
    b = codec.write_tile([{"layer": "y", "extent": 1024, "features": [feature(1, [[[pt(2, 2)]]])]}], "mvt")
    got = back(a + b)["layers"]
    assert [(x["layer"], x["extent"]) for x in got] == [("y", 1024)]


def test_grid_extent_codes_and_images():
    raw = codec.write_grid({"name": "g", "extent": 8192, "size": 2, "data": [-1.0, 2.0, 3.0, 4.0]})
    grid = codec.read_grid(memoryview(raw))
    assert (grid["extent"], grid["size"], grid["min"], grid["max"], codec.sums(grid["data"])) == (8192, 2, -1.0, 4.0, [0, 4915, 6554, 8192])
    coded = bytearray()
    wire.put(coded, 1, 4)
    assert codec.read_grid(memoryview(bytes(coded)))["extent"] == 8192
    image = {"name": "test", "type": "avif", "width": 2, "height": 3, "image": bytes([1, 2, 3, 10])}
    assert codec.read_image(memoryview(codec.write_image(image))) == image
    with pytest.raises(ValueError):
        codec.write_image(image | {"type": "tiff"})


def rows(spark):
    v = lambda x, y: {"x": x, "y": y, "z": None, "m": None}
    data = [("0/0/0", "a", i, 1, json.dumps({"name": f"n{i}", "k": i}), [[[v(i, 2 * i)]]]) for i in range(5)] + [("0/0/1", "b", 0, 2, json.dumps({"name": "line"}), [[[v(0, 0), v(3, 4)]]])]
    return spark.createDataFrame(data, "tile_id string, layer string, fid int, type int, properties string, geometry array<array<array<struct<x:bigint,y:bigint,z:bigint,m:string>>>>")


def test_files_source_stream_and_table_function(spark, tmp_path):
    made = encode.encode_tiles(rows(spark), "open").collect()
    for r in made:
        f = tmp_path / "tiles" / (r.tile_id + ".tile")
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(bytes(r.content))
    path = str(tmp_path / "tiles")
    files = tiles.read_files(spark, f"{path}/*/*/*")
    assert {(r.z, r.x, r.y) for r in files.select("z", "x", "y").collect()} == {(0, 0, 0), (0, 0, 1)}
    assert tiles.features(files, ["layer", "type"]).columns == ["tile_id", "layer", "type"]
    tiles.register(spark)
    df = spark.read.format("vtile").option("path", path).load()
    assert df.where("layer = 'a'").count() == 5 and df.where("layer = 'b' AND type = 2").count() == 1 and df.where("layer = 'c'").count() == 0
    assert spark.read.format("vtile").option("path", path).option("columns", "layer, fid").load().columns == ["tile_id", "layer", "fid"]
    tiles.register_udtf(spark)
    files.createOrReplaceTempView("quarry_files")
    got = spark.sql("SELECT t.layer, t.properties FROM quarry_files f, LATERAL tile_features(f.content) t").collect()
    assert sorted(json.loads(r.properties).get("name") for r in got) == ["line", "n0", "n1", "n2", "n3", "n4"]
    from quarry.streaming.tiles import layer_counts, read_stream

    q = layer_counts(read_stream(spark, path, "layer")).writeStream.outputMode("complete").format("memory").queryName("quarry_counts").start()
    try:
        q.processAllAvailable()
        assert {(r.layer, r.n_features) for r in spark.table("quarry_counts").collect()} == {("a", 5), ("b", 1)}
    finally:
        q.stop()


def test_broken_tile_names_itself(spark):
    df = spark.createDataFrame([("t1", bytearray(b"\x22\xff\x01"))], "tile_id string, content binary")
    with pytest.raises(Exception, match="tile t1 can't be read"):
        tiles.features(df).collect()
    empty = spark.createDataFrame([("t2", bytearray(b"")), ("t3", None)], "tile_id string, content binary")
    assert tiles.features(empty).count() == 0 and tiles.layers(empty).count() == 0


def test_transcode_and_sizes(spark):
    mvt = encode.encode_tiles(rows(spark), "mvt")
    back_ = tiles.features(encode.transcode(mvt), ["layer", "fid", "kind", "properties"])
    assert {r.kind for r in back_.collect()} == {"open"} and back_.count() == 6
    assert encode.compressed_sizes(mvt).where("raw > 0 AND gzip > 0").count() == 2
    with pytest.raises(Exception, match="columnar already"):
        reshape.base_features(back_).collect()


def test_hot_tile_keeps_every_feature(spark):
    """One tile holds nearly all rows."""
    df = spark.range(2000).select(F.when(F.col("id") % 50 == 0, "cold").otherwise("hot").alias("tile_id"), F.lit("l").alias("layer"), F.col("id").cast("int").alias("fid"), F.lit(1).alias("type"), F.to_json(F.struct("id")).alias("properties"), F.array(F.array(F.array(F.struct((F.col("id") % 4096).alias("x"), F.col("id").alias("y"), F.lit(None).cast("bigint").alias("z"), F.lit(None).cast("string").alias("m"))))).alias("geometry"))
    assert tiles.features(encode.encode_tiles(df, "open"), ["fid"]).count() == 2000


def test_stream_reads_late_files_of_older_times(spark, tmp_path):
    import os

    from quarry.streaming.tiles import read_stream

    made = {r.tile_id: bytes(r.content) for r in encode.encode_tiles(rows(spark), "open").collect()}
    folder, log, point = tmp_path / "tiles", str(tmp_path / "log"), str(tmp_path / "check")
    folder.mkdir()

    def put(name, data, time):
        (folder / name).write_bytes(data)
        os.utime(folder / name, (time, time))

    def run():
        out = str(tmp_path / "out")
        q = read_stream(spark, str(folder), "layer", log).writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return {(r.layer, r["count"]) for r in spark.read.parquet(out).groupBy("layer").count().collect()}

    put("m.tile", made["0/0/0"], 2_000_000_000)
    assert run() == {("a", 5)}
    put("z.tile", made["0/0/1"], 1_000_000_000)  # older than what was read
    put("a.tile", made["0/0/1"], 2_000_000_000)  # of the same time, with a smaller name
    assert run() == {("a", 5), ("b", 2)}
    assert run() == {("a", 5), ("b", 2)}


def test_columnar_round_trip_of_whatever_the_writer_takes():
    """Any mix of ids, boxes, offsets, indices, triangles and m-values on any type reads back; polygons alone keep the triangles."""
    rng = random.Random(8)
    point = lambda three, m: pt(rng.randrange(4096), rng.randrange(4096), rng.randrange(99) if three else None, {"w": rng.randrange(9)} if m else None)
    features = []
    for _ in range(300):
        kind, m = rng.randrange(1, 7), rng.random() < 0.3
        form, three = (kind - 1) % 3 + 1, kind > 3
        line = lambda: [point(three, m) for _ in range(rng.randrange(2, 5))]  # noqa: B023, E731
        parts = [[line()]] if form == 1 else [[line() for _ in range(rng.randrange(1, 4))]] if form == 2 else [[line() for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(1, 4))]
        f = feature(kind, parts, id=rng.choice([None, 0, 2**64 - 1]), properties={"a": rng.randrange(-5, 5)})
        f["indices"] = rng.choice([None, [3, 1, 2]])
        f["tessellation"] = rng.choice([None, [point(three, False)[:3]]])
        f["bbox"] = rng.choice([None, [-10.0, -20.0, 30.0, 40.0, *([1.5, 2.5] if three else [])]])
        f["offsets"] = rng.choice([None, [[0.5] * len(p) for p in parts]]) if form > 1 else None
        features.append(f)
    got = back(codec.write_tile([{"layer": "l", "extent": 4096, "shape": None, "mshape": None, "features": features}]))["layers"][0]["features"]
    for f, g in zip(sorted(features, key=lambda f: f["type"]), got):
        poly = (f["type"] - 1) % 3 == 2
        assert (g["type"], g["id"], g["geometry"], g["properties"]) == (f["type"], f["id"], f["geometry"], f["properties"])
        assert g["indices"] == (f["indices"] if poly else None) and g["tessellation"] == (f["tessellation"] if poly else None)
        assert (g["bbox"] is None) == (f["bbox"] is None) and (f["bbox"] is None or g["bbox"] == pytest.approx(f["bbox"], abs=3e-5))
        assert f["offsets"] is None or g["offsets"] == f["offsets"]


def test_broken_numbers_name_their_tile(spark):
    short = bytearray()
    wire.put_bytes(short, codec.GRID, bytes([3 << 3 | wire.FIXED32, 1, 2]))  # a float of two bytes
    df = spark.createDataFrame([("t9", short)], "tile_id string, content binary")
    with pytest.raises(Exception, match="tile t9 can't be read"):
        tiles.grids(df).collect()


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**63, 2**64 - 1]
    out = bytearray()
    wire.put_packed(out, 1, values)
    [(_, _, body)] = wire.fields(memoryview(bytes(out)))
    assert wire.packed(body) == values and wire.packed(b"\x01\x02") == [1, 2] and wire.packed(b"") == []
    with pytest.raises(ValueError, match="ten bytes"):
        wire.packed(b"\xff" * 12)
    with pytest.raises(IndexError):
        wire.packed(b"\x80")


def test_columnar_layers_may_be_refused(spark):
    made = encode.encode_tiles(rows(spark), "open")
    assert tiles.layers(encode.transcode(made, "open", columnar="skip")).count() == 0
    with pytest.raises(Exception, match="unsupported vector tile type"):
        encode.transcode(made, "open", columnar="error").collect()
    with pytest.raises(Exception, match="transformed"):
        f = spark.createDataFrame([("t", "l", 0, "Point", False, '{"x":0.5,"y":0.5}', False)], "tile_id string, layer string, fid int, geometry_type string, is_3d boolean, coordinates string, transformed boolean")
        encode.from_unit_square(f).collect()
    with pytest.raises(Exception, match="out of bounds"):
        tiles.features(made, only=3).collect()


def test_shape_of_their_layer_with_features(spark):
    f = spark.createDataFrame([("t", "a", 0, 1, '{"k":1}', [[[(1, 2, None, '{"q":1}'), (1, 3, None, None)]]]), ("t", "b", 0, 1, '{"k":-1}', [[[(1, 2, None, None)]]])], "tile_id string, layer string, fid int, type int, properties string, geometry array<array<array<struct<x:bigint,y:bigint,z:bigint,m:string>>>>")
    made = encode.encode_tiles(f, "open")
    got = {r.layer: (r["shape"], r.mshape) for r in tiles.features(made, ["layer", "shape", "mshape"]).collect()}
    assert got == {r.layer: (r["shape"], r.mshape) for r in tiles.layers(made).collect()} == {"a": ('{"k":"u64"}', '{"q":"u64"}'), "b": ('{"k":"i64"}', None)}
    assert "shape" not in tiles.features(made).columns


@pytest.mark.parametrize("name, encodings", [("add_features", 1), ("mvt_only_reader", 2), ("columnar_layers_are_skipped", 2)])
def test_tiles_are_written_once(spark, name, encodings):
    import io
    from contextlib import redirect_stdout

    from quarry.plans import registry

    with redirect_stdout(io.StringIO()) as plan:
        registry.queries()[name](spark, "/root/testdata/sf0.001").explain()
    assert plan.getvalue().count("FlatMapGroupsInArrow") == encodings
