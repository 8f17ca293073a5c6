"""Golden values of the kernels, and round trips over random values with fixed seeds."""

from __future__ import annotations

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quarry.functions import arrays, bits
from quarry.functions import sql as sqlfuncs
from quarry.sources import codec


def values(spark, column, rows, kind):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r.o for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_zigzag_golden(spark):
    assert values(spark, bits.zigzag, [0, 1, 2, 3, -1, -2, -3], "bigint") == [0, 2, 4, 6, 1, 3, 5]
    assert values(spark, lambda v: bits.zagzig(bits.zigzag(v)), [0, -1, 2**31 - 1, -(2**31), 12345], "bigint") == [0, -1, 2**31 - 1, -(2**31), 12345]


def test_commands(spark):
    got = values(spark, lambda v: bits.command_encode(v.a, v.b), [(1, 1), (4, 10), (4, 1)], "struct<a:bigint,b:bigint>")
    assert got == [9, 84, 12]
    assert [tuple(r) for r in values(spark, bits.command_decode, [9, 84, 12], "bigint")] == [(1, 1), (4, 10), (4, 1)]


def test_weave_golden(spark):
    assert values(spark, lambda v: bits.weave2d(v.a, v.b), [(3, 5), (65535, 65535)], "struct<a:bigint,b:bigint>") == [39, 2**32 - 1]
    assert values(spark, lambda v: bits.weave3d(v.a, v.b, v.c), [(3, 5, 6), (65535,) * 3], "struct<a:bigint,b:bigint,c:bigint>") == [427, 2**48 - 1]
    rng = random.Random(5)
    pairs = [(rng.randrange(65536), rng.randrange(65536)) for _ in range(50)] + [(42913, 32382)]
    assert [tuple(r) for r in values(spark, lambda v: bits.unweave2d(bits.weave2d(v.a, v.b)), pairs, "struct<a:bigint,b:bigint>")] == pairs
    triples = [tuple(rng.randrange(65536) for _ in range(3)) for _ in range(50)]
    assert [tuple(r) for r in values(spark, lambda v: bits.unweave3d(bits.weave3d(v.a, v.b, v.c)), triples, "struct<a:bigint,b:bigint,c:bigint>")] == triples


@pytest.mark.parametrize(("decode", "encode", "plain", "coded"), [
    (arrays.delta_decode, arrays.delta_encode, [55, 22, 11, 33, 22, 44, 23, 42], [110, 65, 21, 44, 21, 44, 41, 38]),
    (arrays.delta_decode, arrays.delta_encode, [0, 7, 2, 9, 4, 5, 3, 1, 8, 6], [0, 14, 9, 14, 9, 2, 3, 3, 14, 3]),
    (arrays.delta_decode_sorted, arrays.delta_encode_sorted, [11, 22, 22, 23, 33, 42, 44, 55], [11, 11, 0, 1, 10, 9, 2, 11]),
    (arrays.delta_decode, arrays.delta_encode, [], []),
])
def test_delta_golden(spark, decode, encode, plain, coded):
    assert values(spark, encode, [plain], "array<bigint>") == [coded]
    assert values(spark, decode, [coded], "array<bigint>") == [plain]


def test_weave_delta_golden(spark):
    two = [(55, 22), (11, 33), (22, 44), (23, 42)]
    assert values(spark, arrays.weave_delta_encode, [two], "array<struct<x:bigint,y:bigint>>") == [[7412, 4925, 828, 14]]
    three = [(*p, i + 1) for i, p in enumerate(two)]
    assert values(spark, arrays.weave_delta_encode_3d, [three], "array<struct<x:bigint,y:bigint,z:bigint>>") == [[362216, 274681, 12536, 58]]
    assert [tuple(p) for p in values(spark, lambda v: arrays.unweave_delta_decode(arrays.weave_delta_encode(v)), [two], "array<struct<x:bigint,y:bigint>>")[0]] == two
    assert [tuple(p) for p in values(spark, lambda v: arrays.unweave_delta_decode_3d(arrays.weave_delta_encode_3d(v)), [three], "array<struct<x:bigint,y:bigint,z:bigint>>")[0]] == three


def test_weave_delta_rejects_wide_steps(spark):
    with pytest.raises(Exception, match="16 bits"):
        values(spark, arrays.weave_delta_encode, [[(0, 0), (40000, 0)]], "array<struct<x:bigint,y:bigint>>")


def test_quantize_golden(spark):
    assert values(spark, bits.quantize_lon, [-179.6765432, 180.0, -180.0], "double") == [15074, 16777215, 0]
    assert values(spark, bits.quantize_lat, [-89.235657434254, 90.0], "double") == [71242, 16777215]
    assert values(spark, bits.dequantize_lon, [15074], "bigint") == pytest.approx([-179.67654703119678], abs=1e-12)
    assert values(spark, bits.dequantize_lat, [71242], "bigint") == pytest.approx([-89.23565621588565], abs=1e-12)


def test_bbox_bytes_match_codec(spark):
    rng = random.Random(2)
    boxes = [tuple(rng.uniform(-h, h) for h in (180, 90, 180, 90)) + (rng.uniform(-1e4, 1e4), rng.uniform(-1e4, 1e4)) for _ in range(30)] + [(0.0, -162.2 + 90, 1.0, 2.0, 0.0, -0.0)]
    kind = "struct<left:double,bottom:double,right:double,top:double,near:double,far:double>"
    flat = values(spark, arrays.quantize_bbox, boxes, kind)
    deep = values(spark, lambda v: arrays.quantize_bbox(v, three=True), boxes, kind)
    assert [bytes(b) for b in flat] == [codec.box_bytes(list(b[:4])) for b in boxes]
    assert [bytes(b) for b in deep] == [codec.box_bytes(list(b)) for b in boxes]
    back = values(spark, arrays.dequantize_bbox, deep, "binary")
    assert [list(r) for r in back] == [pytest.approx(codec.box_values(bytes(d))) for d in deep]


def test_bbox_outside_wraps_in_24_bits():
    assert codec.box_values(codec.box_bytes([0, -162.2, 0, 0]))[1] == pytest.approx(17.800014483929544, abs=1e-9)


def test_float_bytes(spark):
    rng = random.Random(3)
    floats = [0.0, -0.0, 1.0, -2.5, 1e-40, -1.4e-45, 3.4028234e38, float("inf"), float("-inf"), 0.1, 2.0**-126] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-30, 30) for _ in range(60)]
    packed = values(spark, bits.pack_float, floats, "double")
    assert [bytes(b) for b in packed] == [struct.pack("<f", v) for v in floats]
    back = values(spark, bits.unpack_float, packed, "binary")
    assert back == [struct.unpack("<f", struct.pack("<f", v))[0] for v in floats]
    assert math.isnan(values(spark, lambda v: bits.unpack_float(bits.pack_float(v)), [float("nan")], "double")[0])


def test_offsets_and_codes(spark):
    assert values(spark, bits.encode_offset, [1.234, 0.0, 1.2345], "double") == [1234, 0, 1234]
    with pytest.raises(Exception, match="negative"):
        values(spark, bits.encode_offset, [-1.0], "double")
    assert values(spark, bits.encode_extent, [512, 8192, 16384], "int") == [0, 4, 5]
    assert values(spark, bits.decode_extent, [0, 4, 5], "int") == [512, 8192, 16384]
    with pytest.raises(Exception, match="invalid extent"):
        values(spark, bits.encode_extent, [1000], "int")
    assert values(spark, bits.shape_type_code, ["string", "null"], "string") == [1, 7]
    assert values(spark, bits.image_type_name, [0, 4, 8], "int") == ["png", "avif", "unknown"]
    with pytest.raises(Exception, match="invalid image"):
        values(spark, bits.image_type_code, ["tiff"], "string")


def test_elevation_golden(spark):
    rgb = [(0, 0, 0), (255, 255, 255), (0, 255, 0)]
    kind = "struct<r:int,g:int,b:int>"
    assert values(spark, lambda v: bits.elevation_rgb(v.r, v.g, v.b), rgb, kind) == pytest.approx([-10000, 1667721.5, -3472])
    assert values(spark, lambda v: bits.elevation_terrarium(v.r, v.g, v.b), rgb[:2], kind) == [-32768, 32767.99609375]


def test_rounding_is_half_up(spark):
    assert values(spark, bits.half_up, [2.5, -2.5, -0.5, 0.49], "double") == [3, -2, 0, 0]


def test_grid_golden(spark):
    grid = values(spark, lambda v: arrays.grid_encode(v, 8192), [[-1.0, 2.0, 3.0, 4.0]], "array<double>")[0]
    assert (grid["min"], grid["max"]) == (-1.0, 4.0)
    back = values(spark, lambda v: arrays.grid_decode(arrays.grid_encode(v, 8192).data, F.lit(-1.0), F.lit(4.0), 8192), [[-1.0, 2.0, 3.0, 4.0]], "array<double>")[0]
    assert back == pytest.approx([-1, 1.9998779296875, 3.000244140625, 4])
    assert values(spark, lambda v: arrays.grid_encode(v, 8192).data, [[7.0, 7.0]], "array<double>") == [[0, 0]]
    low = values(spark, lambda v: arrays.grid_encode(v, 8192, from_zero=True), [[3.0, 4.0]], "array<double>")[0]
    assert (low["min"], low["max"]) == (0.0, 4.0)


RING = "array<array<struct<x:bigint,y:bigint>>>"
OUTER, HOLE, FLAT = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(2, 2), (2, 4), (4, 4), (4, 2), (2, 2)], [(0, 0), (5, 5), (0, 0)]


def test_rings(spark):
    areas = values(spark, arrays.signed_area, [OUTER, HOLE, FLAT, []], "array<struct<x:bigint,y:bigint>>")
    assert areas == [codec.area2(r) for r in (OUTER, HOLE, FLAT, [])] == [200, -8, 0, 0]
    cases = [[OUTER, HOLE, OUTER], [OUTER], [FLAT, FLAT], [FLAT, OUTER, HOLE], [FLAT], [HOLE, OUTER, HOLE, HOLE]]
    got = [[[[tuple(p) for p in r] for r in poly] for poly in case] for case in values(spark, arrays.classify_rings, cases, RING)]
    assert got == [codec.group_rings(c) for c in cases]
    assert got[0] == [[OUTER, HOLE], [OUTER]]
    assert got[2] == [[FLAT, FLAT]]
    assert got[3] == [[OUTER, HOLE]]


def test_tessellation(spark):
    assert [[tuple(p) for p in t] for t in values(spark, arrays.fix_tessellation, [[1, 2, 3, 4], []], "array<bigint>")] == [[(1, 2), (3, 4)], []]
    with pytest.raises(Exception, match="even number"):
        values(spark, arrays.fix_tessellation, [[1, 2, 3]], "array<bigint>")


def test_row_forms_match_array_forms(spark):
    rng = random.Random(9)
    lists = [[rng.randrange(-1000, 1000) for _ in range(rng.randrange(1, 20))] for _ in range(20)]
    coded = values(spark, arrays.delta_encode, lists, "array<bigint>")
    rows = spark.createDataFrame([(k, i, v) for k, x in enumerate(lists) for i, v in enumerate(x)], "k int, i int, v bigint")
    made = arrays.delta_decode_rows(arrays.delta_encode_rows(rows, ["k"], ["i"], "v", "d"), ["k"], ["i"], "d", "b").collect()
    assert {(r.k, r.i): (r.d, r.b) for r in made} == {(k, i): (coded[k][i], v) for k, x in enumerate(lists) for i, v in enumerate(x)}


def test_sql_functions(spark):
    names = sqlfuncs.register(spark)
    assert len(names) == 12
    row = spark.sql("SELECT tile_zigzag(-3L) AS z, tile_zagzig(5L) AS b, tile_weave2d(3L, 5L) AS w, tile_weave3d(3L, 5L, 6L) AS t, tile_quantize_lon(-179.6765432D) AS q, tile_command_encode(4L, 10L) AS c").first()
    assert tuple(row) == (5, -3, 39, 427, 15074, 84)


def test_running_sums_of_long_arrays(spark):
    """Folded in blocks beyond a length, with the same sums."""
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i * 37 % 101 - 50).cast("bigint")).alias("a")).select(F.slice("a", 1, n).alias("a"))
        row = df.select("a", arrays.delta_decode(arrays.delta_encode(F.col("a"))).alias("b"), arrays.delta_decode_sorted(F.col("a")).alias("s")).first()
        assert row.a == row.b and len(row.a) == n
        assert row.s == [sum(row.a[: i + 1]) for i in range(n)] if n < 300 else row.s[-1] == sum(row.a)
