"""Sinks: features, grids and images to tiles. One shuffle by tile; a tile is written in one task."""

from __future__ import annotations

import json
from collections.abc import Iterable
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import bulk, codec
from . import reshape


def _geometries(column: pa.ChunkedArray) -> list:
    """A column of geometries as lists of polygons of rings of (x, y, z, m)."""
    polys = column.combine_chunks()
    rings, points = polys.values, polys.values.values
    vertex = points.values
    names = {f.name for f in vertex.type}
    axes = [vertex.field(c).to_pylist() if c in names else [None] * len(vertex) for c in "xyzm"]
    axes[3] = [None if m is None else json.loads(m) for m in axes[3]]
    made = list(zip(*axes))
    for level in (points, rings):
        made = [made[a:b] for a, b in pairwise(level.offsets.to_pylist())]
    return [made[a:b] if there else None for (a, b), there in zip(pairwise(polys.offsets.to_pylist()), polys.is_valid().to_pylist())]


def _tile(table: pa.Table, shapes: dict[str, tuple], kind: str, always: Iterable[str] = ()) -> bytes:
    """A tile of features. always: layers that the tile has even without features."""
    order = [("layer", "ascending"), ("fid", "ascending"), *([("id", "ascending")] if "id" in table.column_names else [])]
    table = table.sort_by(order)
    try:
        return bulk.write_tile(table, kind, shapes, always)
    except bulk.Odd:
        return codec.write_tile(_layers(table, shapes, always), kind)


def _layers(table: pa.Table, shapes: dict[str, tuple], always: Iterable[str] = ()) -> list[dict]:
    """A tile's layers, features in their order."""
    there = {c: _geometries(table.column(c)) if c == "geometry" else table.column(c).to_pylist() for c in table.column_names}
    nothing = [None] * table.num_rows
    get = lambda c: there.get(c, nothing)
    out: dict[str, dict] = {}

    def layer(name: str, extent: int | None) -> dict:
        if name not in out:
            shape, mshape = shapes.get(name, (None, None))
            out[name] = {"layer": name, "extent": extent or 4096, "shape": shape, "mshape": mshape, "features": []}
        return out[name]

    for name, extent, ident, kind, properties, geometry, offsets, indices, bbox, tessellation in zip(*map(get, ("layer", "extent", "id", "type", "properties", "geometry", "offsets", "indices", "bbox", "tessellation"))):
        f = {"id": ident, "type": kind, "properties": json.loads(properties) if properties else {}, "geometry": geometry, "offsets": offsets, "indices": indices}
        f["bbox"] = [bbox[k] for k in ("left", "bottom", "right", "top", "near", "far")] if bbox else None
        f["tessellation"] = [(p["x"], p["y"], p.get("z")) for p in tessellation] if tessellation else None
        layer(name, extent)["features"].append(f)
    for name in always:
        layer(name, None)
    return [out[name] for name in sorted(out)]


def encode_tiles(features: DataFrame, kind: str = "open", shapes: dict[str, tuple] | None = None, key: str = "tile_id", always: Iterable[str] = (), dealt: bool = False) -> DataFrame:
    """(key, content): a tile for each value of ``key``. kind: open, mvt or flat.

    features has key, layer, fid (order within a layer), type, and of id, extent, properties (JSON), geometry, offsets,
    bbox, indices, tessellation those there are. shapes: by layer, a pair of shapes of properties and m-values; where none
    is given they are inferred from the tile's features. Layers are written in the order of their names; those named in
    ``always`` are in every tile. Tiles are dealt over all of spark.sql.shuffle.partitions: writing them takes time, not
    bytes, so small partitions aren't put together. dealt: the features were made of rows that ``deal`` gave, so they are not
    shuffled again.
    """
    names = [c for c in ("layer", "fid", "id", "type", "extent", "properties", "geometry", "offsets", "bbox", "indices", "tessellation") if c in features.columns]
    given, named = shapes or {}, tuple(always)
    type_of_key = features.schema[key].dataType
    out = T.StructType([T.StructField(key, type_of_key), T.StructField("content", T.BinaryType())])

    def write(table: pa.Table) -> pa.Table:
        content = _tile(table.select(names), given, kind, named)
        return pa.table({key: table.column(key)[:1], "content": pa.array([content], pa.binary())})

    made = features.select(key, *names)
    return (made if dealt else _dealt(made, key)).groupBy(key).applyInArrow(write, out)


def encode_vertices(vertices: DataFrame, kind: str | tuple[str, ...] = "open", order: Iterable[str] = (), lone: str = "keep", count: str | None = None, shapes: dict[str, tuple] | None = None, key: str = "tile_id", always: Iterable[str] = ()) -> DataFrame:
    """(key, content): tiles of points and lines from a row for each vertex, with the bytes that encode_tiles gives for the
    features that the vertices make. One shuffle, of flat rows: features are put together where their tile is written.

    vertices has key, layer, fid, type (1, 4: a point by itself; 2, 5: a vertex of the line of all rows with the same layer,
    fid and id), x, y, and of id, z, extent, properties (a struct of scalars; null: a feature hasn't it), m (the same of a
    vertex; all null: it has none) and offset those there are. order: whole numbers by which a line's vertices are ordered;
    what isn't of a vertex is taken from a line's first. lone: what becomes of lines of one vertex: keep, drop, or point. count: a
    property of lines that gets their number of vertices. Several kinds: a tile of each, which the column kind names.
    """
    several = not isinstance(kind, str)
    kinds, by, given, named = tuple(kind) if several else (kind,), list(order), shapes or {}, tuple(always)
    if lone not in ("keep", "drop", "point"):
        raise ValueError("lone is keep, drop or point")
    plain = [c for c in ("layer", "fid", "type", "x", "y", "z", "id", "extent", "offset") if c in vertices.columns]
    deep = [F.col(c)[f].alias(f"{c[0]}:{f}") for c in ("properties", "m") if c in vertices.columns for f in vertices.schema[c].dataType.names]
    flat = vertices.select(key, *plain, *[F.col(c).alias(f"o:{c}") for c in by], *deep)
    out = T.StructType([T.StructField(key, vertices.schema[key].dataType), *([T.StructField("kind", T.StringType())] if several else []), T.StructField("content", T.BinaryType())])

    def write(table: pa.Table) -> pa.Table:
        rows, made = table.drop_columns([key]), []
        layers = {by_type: bulk.vertex_layers(rows, [f"o:{c}" for c in by], lone, count, by_type) for by_type in {k == "open" for k in kinds}}
        for k in kinds:
            if layers[k == "open"]:
                made.append(bulk.write_layers(layers[k == "open"], k, given, named))
        first = table.column(key).combine_chunks()[:1]
        columns = {key: pa.concat_arrays([first] * len(made)) if made else first[:0]} | ({"kind": pa.array(kinds[: len(made)], pa.string())} if several else {})
        return pa.table({**columns, "content": pa.array(made, pa.binary())})

    return _dealt(flat, key).groupBy(key).applyInArrow(write, out)


def deal(rows: DataFrame, key: str = "tile_id") -> DataFrame:
    """Rows dealt and sorted by tile. Features that are made of them row by row, this column kept as it is, are so too: then
    what they are made of is shuffled and sorted, not they themselves."""
    return _dealt(rows, key).sortWithinPartitions(key)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def encode_grids(grids: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, content): tiles of grids (name, extent, size, data)."""
    return _parts(grids, key, lambda rows: codec.write_tile([], "open", grids=rows))


def encode_images(images: DataFrame, key: str = "tile_id") -> DataFrame:
    """(key, content): tiles of images (name, type, width, height, image)."""
    return _parts(images, key, lambda rows: codec.write_tile([], "open", images=rows))


def _parts(df: DataFrame, key: str, write_rows) -> DataFrame:
    out = T.StructType([df.schema[key], T.StructField("content", T.BinaryType())])

    def write(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["name"])
        return pa.table({key: table.column(key)[:1], "content": pa.array([write_rows(rows)], pa.binary())})

    return _dealt(df, key).groupBy(key).applyInArrow(write, out)


def transcode(tiles: DataFrame, kind: str = "open", key: str = "tile_id", columnar: str | tuple[str, ...] = "rewrite") -> DataFrame:
    """Tiles rewritten in another format, each on its own: narrow, no shuffle.

    columnar: what becomes of layers that are columnar already: rewrite them like the others, skip them, or error. Several:
    a tile for each of them, which its column columnar names; the tiles are read from their source once.
    """
    several = not isinstance(columnar, str)
    ways = tuple(columnar) if several else (columnar,)
    if not set(ways) <= {"rewrite", "skip", "error"}:
        raise ValueError("columnar is rewrite, skip or error")
    named = [T.StructField("columnar", T.StringType())] if several else []
    out = T.StructType([tiles.schema[key], T.StructField("content", T.BinaryType()), *named])

    def rewritten(k, data: bytes, how: str) -> bytes:
        layers = codec.read_tile(data, lazy=True)["layers"]
        if how == "error" and any(x["kind"] == "open" for x in layers):
            raise ValueError(f"tile {k}: unsupported vector tile type")
        try:
            return bulk.rewrite(layers, kind, how == "skip")
        except bulk.Odd:
            layers = codec.read_tile(data)["layers"]
            return codec.write_tile([{**x, "shape": None if x["kind"] != "open" else x["shape"]} for x in layers if how != "skip" or x["kind"] != "open"], kind)

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for how in ways:
                    made = [pa.array([k], batch.schema.field(0).type), pa.array([rewritten(k, data.as_py(), how)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*made, *([pa.array([how])] if several else [])], names=out.names)

    return tiles.select(key, "content").mapInArrow(run, out)


#: Compressions of the size report; each is Arrow's own.
CODECS = ("gzip", "zstd", "brotli")


def compressed_sizes(tiles: DataFrame, key: str = "tile_id") -> DataFrame:
    """tiles with raw and one column for each of CODECS: bytes of the content as it is and compressed."""
    missing = [c for c in CODECS if not pa.Codec.is_available(c)]
    if missing:
        raise RuntimeError(f"this Arrow has no {', '.join(missing)}")
    out = T.StructType([tiles.schema[key], *[T.StructField(c, T.LongType()) for c in ("raw", *CODECS)]])

    def run(batches):
        codecs = [pa.Codec(c) for c in CODECS]
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(d) for d in data], pa.int64()), *[pa.array([c.compress(d).size for d in data], pa.int64()) for c in codecs]], names=[key, "raw", *CODECS])

    return tiles.select(key, "content").mapInArrow(run, out)


def from_unit_square(features: DataFrame, kind: str = "open", guide: dict[str, tuple] | None = None, key: str = "tile_id") -> DataFrame:
    """(key, content): tiles of features of the unit square.

    features has key, layer, fid, geometry_type (a name such as MultiPoint), is_3d, coordinates (JSON), transformed (whether
    the tile's coordinates are of the unit square; where not, that is an error), and of id and properties those there are.
    guide: by layer, its extent, shape and shape of m-values; others have 4096 and what their features give.
    """
    known = guide or {}
    extent = F.lit(4096)
    for name, (size, *_) in known.items():
        extent = F.when(F.col("layer") == name, size).otherwise(extent)
    kind_of = reshape.unit_type("geometry_type", "is_3d")
    kind_of = F.when(F.coalesce("transformed", F.lit(False)), kind_of).otherwise(F.raise_error(F.lit("a tile must be transformed first")).cast("int"))
    made = features.withColumn("extent", extent).withColumn("type", kind_of)
    made = made.withColumn("geometry", reshape.from_unit_square(F.col("type"), reshape.unit_geometry(F.col("geometry_type"), F.col("coordinates")), F.col("extent")))
    return encode_tiles(made, kind, {name: (shape, mshape) for name, (_, shape, mshape) in known.items()}, key)


def write_files(tiles: DataFrame, path: str, key: str = "tile_id") -> None:
    """Tiles as a Parquet table partitioned by nothing but size: (key, content), read again by ``spark.read.parquet``."""
    tiles.select(key, F.col("content")).write.mode("overwrite").parquet(path)
