"""Access to features and reshaping of geometries, as expressions over the canonical columns (see ``sources.model``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bits

GEO_TYPES = ("MultiPoint", "MultiLineString", "MultiPolygon")


def form(kind: Column) -> Column:
    """1 points, 2 lines, 3 polygons, of a type in two or three dimensions."""
    return (kind - 1) % 3 + 1


def geo_type(kind: Column) -> Column:
    return F.when(form(kind) == 1, GEO_TYPES[0]).when(form(kind) == 2, GEO_TYPES[1]).otherwise(GEO_TYPES[2])


def is_type(kind: Column, name: str) -> Column:
    """name: points, lines, polygons, points3d, lines3d or polygons3d."""
    return kind == ("points", "lines", "polygons", "points3d", "lines3d", "polygons3d").index(name) + 1


def has_bbox(box: Column) -> Column:
    """A box is there and not all zeros."""
    return F.coalesce((box.left != 0) | (box.bottom != 0) | (box.right != 0) | (box.top != 0) | (F.coalesce(box.near, F.lit(0.0)) != 0) | (F.coalesce(box.far, F.lit(0.0)) != 0), F.lit(False))


def bbox_or_zeros(box: Column) -> Column:
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("left", "bottom", "right", "top", "near", "far")])
    return F.coalesce(box, zero)


def has_offsets(offsets: Column) -> Column:
    return F.coalesce(F.exists(F.flatten(offsets), lambda o: o > 0), F.lit(False))


def has_m_values(geometry: Column) -> Column:
    return F.coalesce(F.exists(F.flatten(F.flatten(geometry)), lambda p: p.m.isNotNull()), F.lit(False))


def is_single(kind: Column, geometry: Column) -> Column:
    return F.when(form(kind) == 1, F.size(F.flatten(F.flatten(geometry))) == 1).when(form(kind) == 2, F.size(F.flatten(geometry)) == 1).otherwise(F.size(geometry) == 1)


def m_values(geometry: Column) -> Column:
    """One m-value (JSON) per vertex, ``{}`` where one is missing; null if no vertex has any."""
    return F.when(has_m_values(geometry), F.transform(F.flatten(F.flatten(geometry)), lambda p: F.coalesce(p.m, F.lit("{}"))))


def load_points(kind: Column, geometry: Column, drop_closing: bool = False) -> Column:
    """All vertices in order; drop_closing leaves out the last one of each polygon ring."""
    lines = F.flatten(geometry)
    if drop_closing:
        lines = F.transform(lines, lambda r: F.when((form(kind) == 3) & (F.size(r) > 1), F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    return F.flatten(lines)


def load_lines(kind: Column, geometry: Column, offsets: Column | None = None) -> Column:
    """array<struct<line, offset>> of lines or of polygon rings; null for points."""
    lines = F.flatten(geometry)
    off = F.flatten(offsets) if offsets is not None else F.lit(None).cast("array<double>")
    return F.when(form(kind) != 1, F.transform(lines, lambda r, i: F.struct(r.alias("line"), F.coalesce(F.get(off, i), F.lit(0.0)).alias("offset"))))


def load_polys(kind: Column, geometry: Column, offsets: Column | None = None) -> Column:
    """array<array<struct<line, offset>>> of polygons; null for other types."""
    off = offsets if offsets is not None else F.lit(None).cast("array<array<double>>")
    return F.when(form(kind) == 3, F.transform(geometry, lambda p, i: F.transform(p, lambda r, j: F.struct(r.alias("line"), F.coalesce(F.get(F.get(off, i), j), F.lit(0.0)).alias("offset")))))


def _scaled(points: Column, three: Column, scale: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.when(three, F.array(p.x * scale, p.y * scale, F.coalesce(p.z, F.lit(0)) * scale)).otherwise(F.array(p.x * scale, p.y * scale))))


def add_tessellation(flat: Column, kind: Column, tessellation: Column, scale: Column) -> Column:
    return F.concat(flat, F.coalesce(_scaled(tessellation, kind > 3, scale), F.array().cast("array<double>")))


def load_flat(kind: Column, geometry: Column, extent: Column, tessellation: Column | None = None) -> Column:
    """x, y (and z in three dimensions) of all vertices as shares of the extent, then those of the tessellation."""
    scale = F.lit(1.0) / extent
    flat = _scaled(F.flatten(F.flatten(geometry)), kind > 3, scale)
    return flat if tessellation is None else add_tessellation(flat, kind, tessellation, scale)


def read_indices(indices: Column) -> Column:
    return F.coalesce(indices, F.array().cast("array<bigint>"))


def vertices(features: DataFrame, keys: list[str]) -> DataFrame:
    """A row per vertex: keys, poly, ring, pos, x, y, z, m. Narrow."""
    a = features.select(*keys, F.posexplode("geometry").alias("poly", "_p"))
    b = a.select(*keys, "poly", F.posexplode("_p").alias("ring", "_r"))
    return b.select(*keys, "poly", "ring", F.posexplode("_r").alias("pos", "_v")).select(*keys, "poly", "ring", "pos", "_v.*")


# Conversions


def from_unit_square(kind: Column, geometry: Column, extent) -> Column:
    """A geometry of the unit square (its vertices doubles, m JSON) on the extent's grid; m-values stay."""
    three = kind > 3
    place = lambda v: F.struct(bits.half_up(v.x * extent).alias("x"), bits.half_up(v.y * extent).alias("y"), F.when(three, bits.half_up(F.coalesce(v.z, F.lit(0.0)) * extent)).alias("z"), v.m.alias("m"))
    return F.transform(geometry, lambda p: F.transform(p, lambda r: F.transform(r, place)))


UNIT_FEATURE = "struct<type:string,is3D:boolean,coordinates:string>"


def unit_geometry(geo_type_name: Column, coordinates: Column) -> Column:
    """The canonical geometry of a JSON text of coordinates: objects {x, y, z?, m?} in 0..1, nested as the type says."""
    vertex = "struct<x:double,y:double,z:double,m:string>"
    deep = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
    parsed = lambda n: F.from_json(coordinates, "array<" * n + vertex + ">" * n)
    one = F.from_json(coordinates, vertex)
    out = F.when(geo_type_name == "Point", F.array(F.array(F.array(one))))
    for name, n in deep.items():
        if name == "Point":
            continue
        g = parsed(n)
        nested = F.array(F.array(g)) if n == 1 else F.array(g) if n == 2 else g
        out = out.when(geo_type_name == name, nested)
    return out


def unit_type(geo_type_name: Column | str, is_3d: Column | str) -> Column:
    geo_type_name, is_3d = (F.col(c) if isinstance(c, str) else c for c in (geo_type_name, is_3d))
    base = F.when(geo_type_name.endswith("Point"), 1).when(geo_type_name.endswith("LineString"), 2).when(geo_type_name.endswith("Polygon"), 3).otherwise(F.raise_error(F.concat(F.lit("unknown geometry "), geo_type_name)).cast("int"))
    return base + F.when(is_3d, 3).otherwise(0)


def base_features(features: DataFrame) -> DataFrame:
    """Features of row-oriented layers in the schema that the writers take; columnar layers are an error."""
    kind = F.when(F.col("kind") == "open", F.raise_error(F.concat(F.lit("layer "), F.col("layer"), F.lit(" is columnar already"))).cast("string")).otherwise(F.col("kind"))
    return features.withColumn("kind", kind)


def add_features(features: DataFrame, more: DataFrame, key: str = "tile_id") -> DataFrame:
    """features and more; those of more come after all that their tile's layer has, in their own order, new layers from 0.

    Shapes follow when a tile is written: they are inferred from all features of a layer, unless some are given.
    """
    last = features.groupBy(key, "layer").agg(F.max("fid").alias("_last"))
    rank = F.row_number().over(W.partitionBy(key, "layer").orderBy("fid"))
    added = more.withColumn("_rank", rank).join(last, [key, "layer"], "left")
    added = added.withColumn("fid", (F.coalesce("_last", F.lit(-1)) + F.col("_rank")).cast(features.schema["fid"].dataType)).drop("_last", "_rank")
    return features.unionByName(added, allowMissingColumns=True)


def layer_union(*parts: DataFrame, key: str = "tile_id") -> DataFrame:
    """Layers of several tables in one; of equal names in a tile the one of the last table (then highest layer_ord) stays."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    w = W.partitionBy(key, "layer").orderBy(F.desc("_part"), F.desc("layer_ord"))
    return out.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_part")


def stable_by_type(features: DataFrame, keys: list[str], order: str = "fid") -> DataFrame:
    """features with ``position``: their place within the keys by type, then the order they had."""
    return features.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy("type", order)) - 1)


def type_counts(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features of each type, and all, by the keys; one shuffle of partial counts."""
    names = ("points", "lines", "polygons", "points3d", "lines3d", "polygons3d")
    return features.groupBy(*keys).agg(*[F.count_if(F.col("type") == i + 1).alias(n) for i, n in enumerate(names)], F.count("*").alias("all"))


def average_by(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Averages by key and over all (key null)."""
    return df.rollup(key).agg(*[F.avg(v).alias(f"avg_{v}") for v in values], F.count("*").alias("n"))
