"""Array kernels as Column expressions, and the same over rows with windows.

The array forms suit the arrays of one geometry, held in one row; the row forms (suffix ``_rows``) take any length, one
shuffle by the group's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bits

LONGS = "array<bigint>"
MIN16, MAX16 = -32768, 32767


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value evaluated once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _differences(a: Column, then: Callable[[Column], Column]) -> Column:
    return F.transform(a, lambda v, i: then(v.cast("bigint") - F.when(i > 0, F.get(a, i - 1)).otherwise(0).cast("bigint")))


#: Elements up to which running sums are one fold; longer arrays are folded in blocks.
SHORT = 256


def _sums(a: Column) -> Column:
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(LONGS).alias("out"))
    step = lambda s, v: F.struct((s["at"] + v).alias("at"), F.array_append(s["out"], s["at"] + v).alias("out"))
    return F.aggregate(a, start, step, lambda s: s["out"])


def _running(a: Column, first: Callable[[Column], Column]) -> Column:
    """Running sums. A fold copies what it has at each step, so long arrays go in blocks of about the root of their length:
    sums within each block, sums of the blocks, and both added."""

    def blocked(values: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(values))).cast("int")
        blocks = let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / n).cast("int")), lambda b: _sums(F.slice(values, b * n + 1, n))))
        before = lambda sums: F.concat(F.array(F.lit(0).cast("bigint")), _sums(F.transform(sums, lambda x: F.element_at(x, -1))))
        return let(blocks, lambda sums: let(before(sums), lambda start: F.flatten(F.transform(sums, lambda x, i: F.transform(x, lambda v: v + F.get(start, i))))))

    return let(F.transform(a, first), lambda values: F.when(F.size(values) > SHORT, blocked(values)).otherwise(_sums(values)))


def delta_encode(a: Column) -> Column:
    return _differences(a, bits.zigzag)


def delta_decode(a: Column) -> Column:
    return _running(a, bits.zagzig)


def delta_encode_sorted(a: Column) -> Column:
    return _differences(a, lambda d: d)


def delta_decode_sorted(a: Column) -> Column:
    return _running(a, lambda v: v.cast("bigint"))


def _axis(points: Column, name: str) -> Column:
    return F.transform(points, lambda p: p[name])


def _checked(d: Column) -> Column:
    """A difference that fits 16 bits signed; another one can't be interleaved and is an error."""
    return F.when(d.between(MIN16, MAX16), d).otherwise(F.raise_error(F.concat(F.lit("a step of "), d.cast("string"), F.lit(" does not fit 16 bits"))).cast("bigint"))


def _steps(points: Column, names: str, weave: Callable[..., Column]) -> Column:
    """Each point's zigzagged steps from the one before (the first from 0), interleaved."""
    gap = lambda p, i, k: p[k].cast("bigint") - F.when(i > 0, F.get(points, i - 1)[k]).otherwise(0).cast("bigint")
    steps = F.transform(points, lambda p, i: F.struct(*[gap(p, i, k).alias(k) for k in names]))
    return F.transform(steps, lambda d: weave(*[bits.zigzag(_checked(d[k])) for k in names]))


def weave_delta_encode(points: Column) -> Column:
    """array<struct<x, y>> to one interleaved number each."""
    return _steps(points, "xy", bits.weave2d)


def weave_delta_encode_3d(points: Column) -> Column:
    return _steps(points, "xyz", bits.weave3d)


def unweave_delta_decode(a: Column) -> Column:
    return let(F.transform(a, bits.unweave2d), lambda t: F.arrays_zip(delta_decode(_axis(t, "a")).alias("x"), delta_decode(_axis(t, "b")).alias("y")))


def unweave_delta_decode_3d(a: Column) -> Column:
    return let(F.transform(a, bits.unweave3d), lambda t: F.arrays_zip(*[delta_decode(_axis(t, k)).alias(n) for k, n in zip("abc", "xyz")]))


def quantize_bbox(b: Column, three: bool = False) -> Column:
    """A box (left, bottom, right, top[, near, far]) as 12 bytes, or 20 with two floats."""
    parts = [bits.pack24(bits.quantize_lon(b.left)), bits.pack24(bits.quantize_lat(b.bottom)), bits.pack24(bits.quantize_lon(b.right)), bits.pack24(bits.quantize_lat(b.top))]
    if three:
        parts += [bits.pack_float(b.near), bits.pack_float(b.far)]
    return F.concat(*parts)


def dequantize_bbox(data: Column) -> Column:
    """The box of 12 or 20 bytes; near and far are null in 12."""
    far = F.length(data) == 20
    return F.struct(
        bits.dequantize_lon(bits.unpack24(data, 1)).alias("left"), bits.dequantize_lat(bits.unpack24(data, 4)).alias("bottom"), bits.dequantize_lon(bits.unpack24(data, 7)).alias("right"), bits.dequantize_lat(bits.unpack24(data, 10)).alias("top"),
        F.when(far, bits.unpack_float(data, 13)).alias("near"), F.when(far, bits.unpack_float(data, 17)).alias("far"),
    )


def fix_tessellation(a: Column) -> Column:
    """A flat list of numbers as points; an odd length is an error."""
    n = F.when(F.size(a) % 2 == 0, F.size(a)).otherwise(F.raise_error(F.lit("a tessellation has an even number of values")).cast("int"))
    return F.transform(F.filter(a, lambda v, i: i % 2 == 0), lambda v, i: F.struct(v.alias("x"), F.get(a, F.least(2 * i + 1, n - 1)).alias("y")))


def signed_area(ring: Column) -> Column:
    """Twice the area of a ring, its sign telling the winding; 0 for an empty ring."""
    n = F.size(ring)
    return F.aggregate(F.transform(ring, lambda p, i: (F.get(ring, (i + n - 1) % n).x.cast("bigint") - p.x) * (p.y.cast("bigint") + F.get(ring, (i + n - 1) % n).y)), F.lit(0).cast("bigint"), lambda s, v: s + v)


def classify_rings(rings: Column) -> Column:
    """Rings grouped to polygons: the first ring that has an area sets the outer winding, another of that winding begins a
    polygon, the other winding is a hole; rings without area are left out. A single ring, and rings that all lack area,
    stay together as they are."""
    sized = F.filter(F.transform(rings, lambda r: F.struct(signed_area(r).alias("area"), r.alias("ring"))), lambda r: r.area != 0)
    begins = lambda s: F.filter(F.transform(s, lambda r, i: F.when(F.signum(r.area) == F.signum(s[0].area), i)), lambda i: i.isNotNull())
    cut = lambda s, b: F.transform(b, lambda k, i: F.transform(F.slice(s, k + 1, F.coalesce(F.get(b, i + 1), F.size(s)) - k), lambda r: r.ring))
    return F.when(F.size(rings) <= 1, F.array(rings)).otherwise(let(sized, lambda s: F.when(F.size(s) == 0, F.array(rings)).otherwise(let(begins(s), lambda b: cut(s, b)))))


def remap(v: Column, low: Column, high: Column, extent) -> Column:
    """A value of low..high on the grid 0..extent; 0 where the range is empty."""
    return F.when(high > low, bits.half_up((v - low) * extent / (high - low))).otherwise(F.lit(0).cast("bigint"))


def unmap(v: Column, low: Column, high: Column, extent) -> Column:
    return v * (high - low) / extent + low


def grid_encode(data: Column, extent, from_zero: bool = False) -> Column:
    """A grid's values as struct<min, max, data>: remapped and delta-encoded. from_zero widens the range to hold 0."""
    low, high = F.array_min(data), F.array_max(data)
    if from_zero:
        low, high = F.least(low, F.lit(0.0)), F.greatest(high, F.lit(0.0))
    mapped = lambda r: F.transform(r.data, lambda v: remap(v, r["min"], r["max"], extent))
    return let(F.struct(low.alias("min"), high.alias("max"), data.alias("data")), lambda r: F.struct(r["min"].alias("min"), r["max"].alias("max"), let(mapped(r), delta_encode).alias("data")))


def grid_decode(data: Column, low: Column, high: Column, extent) -> Column:
    return let(F.struct(low.alias("low"), high.alias("high"), delta_decode(data).alias("data")), lambda r: F.transform(r.data, lambda v: unmap(v, r.low, r.high, extent)))


# The same over rows: one shuffle by key, any length.


def delta_encode_rows(df: DataFrame, key: list[str], order: list[str], value: str, out: str, sort: bool = False) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order)
    d = F.col(value).cast("bigint") - F.lag(F.col(value).cast("bigint"), 1, 0).over(w)
    return df.withColumn(out, d if sort else bits.zigzag(d))


def delta_decode_rows(df: DataFrame, key: list[str], order: list[str], value: str, out: str, sort: bool = False) -> DataFrame:
    w = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.col(value) if sort else bits.zagzig(F.col(value))).over(w))


def classify_rings_rows(df: DataFrame, key: list[str], order: str, area: str, out: str) -> DataFrame:
    """Rows of rings with their polygon's number (from 0) in ``out``; rings without area are left out."""
    w = W.partitionBy(*key).orderBy(order)
    df = df.where(F.col(area) != 0)
    first = F.first(F.signum(area)).over(w)
    return df.withColumn("_first", first).withColumn(out, F.sum(F.when(F.signum(area) == F.col("_first"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_first")
