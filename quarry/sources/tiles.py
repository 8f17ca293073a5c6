"""Tiles as DataFrames: a table or folder of tile bytes to layers, features, grids and images.

Parsing is narrow: one pass over a BINARY column in Arrow batches, no shuffle. ``columns`` says which feature columns are
wanted; others are neither decoded nor sent back. Tiles may also be read through ``spark.read.format("vtile")`` and
``spark.readStream.format("vtile")``; the batch reader takes filters on layer, kind and type, by layer before decoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from . import bulk, codec, model

ZXY = r"(\d+)[/_-](\d+)[/_-](\d+)\.\w+(?:\.\w+)?$"
BOX_NAMES = ("left", "bottom", "right", "top", "near", "far")


def _text(value) -> str | None:
    return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def feature_rows(tile: dict, names: list[str]) -> Iterator[dict]:
    """Rows of a parsed tile's features with the named columns."""
    for layer in tile["layers"]:
        for f in layer["features"]:
            row = {"layer": layer["layer"], "kind": layer["kind"], "extent": layer["extent"], "fid": f["fid"], "type": f["type"]}
            row |= {c: _text(layer[c]) for c in ("shape", "mshape") if c in names}
            if "id" in names:
                row["id"] = None if f["id"] is None else f["id"]
            if "properties" in names:
                row["properties"] = _text(f["properties"])
            if "geometry" in names and f["geometry"] is not None:
                row["geometry"] = [[[{"x": x, "y": y, "z": z, "m": _text(m)} for x, y, z, m in r] for r in p] for p in f["geometry"]]
            for k in ("offsets", "indices"):
                if k in names:
                    row[k] = f[k]
            if "bbox" in names and f["bbox"] is not None:
                row["bbox"] = dict(zip(BOX_NAMES, f["bbox"]))
            if "tessellation" in names and f["tessellation"] is not None:
                row["tessellation"] = [dict(zip("xyz", p)) for p in f["tessellation"]]
            yield {n: row.get(n) for n in names}


def layer_rows(tile: dict) -> Iterator[dict]:
    for i, x in enumerate(tile["layers"]):
        yield {"layer_ord": i, "kind": x["kind"], "version": x["version"], "layer": x["layer"], "extent": x["extent"], "shape": _text(x["shape"]), "mshape": _text(x["mshape"]), "n_features": x["n_features"]}


def _nested(geometries: list, kind: pa.DataType) -> pa.Array:
    """Geometries (polygon, ring, vertex tuples; None where there is none) as one array of the nested type."""
    polys, rings, points = [0], [0], [0]
    axes: list[list] = [[], [], [], []]
    for g in geometries:
        for poly in g or ():
            for ring in poly:
                if ring:
                    for a, v in zip(axes, zip(*ring)):
                        a.extend(v)
                points.append(len(axes[0]))
            rings.append(len(points) - 1)
        polys.append(len(rings) - 1)
    axes[3] = [_text(m) for m in axes[3]]
    vertex = kind.value_type.value_type.value_type
    flat = pa.StructArray.from_arrays([pa.array(a, f.type) for a, f in zip(axes, vertex)], fields=list(vertex))
    made = pa.ListArray.from_arrays(pa.array(points, pa.int32()), flat, type=kind.value_type.value_type)
    made = pa.ListArray.from_arrays(pa.array(rings, pa.int32()), made, type=kind.value_type)
    return pa.ListArray.from_arrays(pa.array(polys, pa.int32()), made, type=kind, mask=pa.array([g is None for g in geometries], pa.bool_()))


def feature_batch(tile: dict, schema: pa.Schema, key: str, value) -> pa.RecordBatch:
    """A parsed tile's features as columns of the schema, whose first one is the tile's key."""
    made = [(x, f) for x in tile["layers"] for f in x["features"]]
    out = []
    for field in schema:
        name = field.name
        if name == key:
            out.append(pa.array([value] * len(made), field.type))
        elif name in ("layer", "kind", "extent"):
            out.append(pa.array([x[name] for x, _ in made], field.type))
        elif name in ("shape", "mshape"):
            out.append(pa.array([_text(x[name]) for x, _ in made], field.type))
        elif name == "id":
            out.append(pa.array([f["id"] for _, f in made], pa.uint64()).cast(field.type))
        elif name == "properties":
            out.append(pa.array([_text(f["properties"]) for _, f in made], field.type))
        elif name == "geometry":
            out.append(_nested([f["geometry"] for _, f in made], field.type))
        elif name == "bbox":
            out.append(pa.array([f["bbox"] and dict(zip(BOX_NAMES, f["bbox"])) for _, f in made], field.type))
        elif name == "tessellation":
            out.append(pa.array([f["tessellation"] and [dict(zip("xyz", p)) for p in f["tessellation"]] for _, f in made], field.type))
        else:
            out.append(pa.array([f[name] for _, f in made], field.type))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def _batches(tiles: DataFrame, schema: T.StructType, make, key: str, content: str) -> DataFrame:
    """make(schema, key's value, bytes) gives a tile's rows in batches; each goes out as it is made, so one tile is held."""
    out = T.StructType([tiles.schema[key], *schema])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if data.is_valid:
                    try:
                        for made in make(arrow, k, data.as_py()):
                            if made.num_rows:
                                yield made
                    except (ValueError, IndexError, KeyError, StopIteration) as e:
                        raise ValueError(f"tile {k} can't be read: {e}") from e

    return tiles.select(key, content).mapInArrow(run, out)


def _parse(tiles: DataFrame, schema: T.StructType, rows, key: str, content: str) -> DataFrame:
    """Small tables of a tile (layers, grids, images), features undecoded."""
    return _batches(tiles, schema, lambda arrow, k, data: [pa.RecordBatch.from_pylist([{key: k, **r} for r in rows(codec.read_tile(data, set(), None, count=True))], schema=arrow)], key, content)


def features(tiles: DataFrame, columns: list[str] | None = None, layers: list[str] | None = None, key: str = "tile_id", content: str = "content", rows_only: bool = False, only: int | None = None, missing: str = "error", values: str | None = None) -> DataFrame:
    """Features of a table of tiles (key, content); columns: those wanted (None for all); layers: their names (None: all).

    rows_only: a tile with anything but row-oriented layers is an error. only: the one feature of each layer that has this
    index (from 0); a layer that has fewer is an error, or has none where missing is "skip". values: fields such as
    "k bigint, name string": properties of these names as a struct of typed columns, without a JSON text between; null where a
    feature has none, an error where a value is of another type.
    """
    schema = model.feature_schema(columns)
    if values is not None:
        schema = T.StructType([*schema, T.StructField("values", T.StructType.fromDDL(values))])
    named = set(layers) if layers is not None else None
    return _batches(tiles, schema, lambda arrow, k, data: bulk.batches(data, arrow, key, k, named, rows_only, only, missing == "skip"), key, content)


def layers(tiles: DataFrame, key: str = "tile_id", content: str = "content") -> DataFrame:
    """Layers with their shapes and numbers of features, which are counted, not decoded."""
    return _batches(tiles, model.LAYERS, lambda arrow, k, data: [pa.RecordBatch.from_pylist([{key: k, **r} for r in layer_rows(codec.read_tile(data, set(), None, count=True))], schema=arrow)], key, content)


def readable(tiles: DataFrame, key: str = "tile_id", content: str = "content", rows_only: bool | tuple[bool, ...] = False, only: int | None = None) -> DataFrame:
    """key, readable, problem: whether each tile can be read in this way (see features()), and why not. Several rows_only: a
    row for each of them, which it names; the tiles are made once."""
    several = not isinstance(rows_only, bool)
    schema = T.StructType([T.StructField("readable", T.BooleanType()), T.StructField("problem", T.StringType()), *([T.StructField("rows_only", T.BooleanType())] if several else [])])

    def look(arrow, k, data):
        rows = []
        for strict in rows_only if several else (rows_only,):
            try:
                codec.read_tile(data, set(), None, strict, only)
                problem = None
            except (ValueError, IndexError, KeyError, StopIteration) as e:
                problem = str(e)
            rows.append({key: k, "readable": problem is None, "problem": problem} | ({"rows_only": strict} if several else {}))
        return [pa.RecordBatch.from_pylist(rows, schema=arrow)]

    return _batches(tiles, schema, look, key, content)


def grids(tiles: DataFrame, key: str = "tile_id", content: str = "content") -> DataFrame:
    """Grids with their data as stored numbers; see ``functions.arrays.grid_decode``."""
    return _parse(tiles, model.GRIDS, lambda t: t["grids"], key, content)


def images(tiles: DataFrame, key: str = "tile_id", content: str = "content") -> DataFrame:
    return _parse(tiles, model.IMAGES, lambda t: t["images"], key, content)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Tile files as rows: tile_id (the path), z, x, y from names like z/x/y.pbf (null where there are none), content."""
    raw = spark.read.format("binaryFile").load(path)
    part = lambda i: F.nullif(F.regexp_extract("path", ZXY, i), F.lit("")).cast("int")
    return raw.select(F.col("path").alias("tile_id"), part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "content")


# The same as a data source


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def _system(path: str):
    """The file system of a path or address, and the path in it."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _root(path: str) -> str:
    return _system(path)[1].rstrip("/")


def _listed(path: str, there: bool = True) -> list[tuple[str, float]]:
    """Files below a path and their times, by any file system that Arrow knows; there: whether it must be."""
    import pyarrow.fs as fs

    system, root = _system(path)
    info = system.get_file_info(root)
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=not there))
    return sorted((i.path, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))


def _opened(path: str, root: str) -> bytes:
    with _system(root)[0].open_input_stream(path) as f:
        return f.read()


def _written(path: str, root: str, data: bytes) -> None:
    """A whole file or none: written beside its place and moved there."""
    system = _system(root)[0]
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/.{name}") as f:
        f.write(data)
    system.move(f"{folder}/.{name}", path)


class _Rows:
    """What the batch and the stream reader share."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.names = schema.names
        self.root = options["path"]
        self.only: dict[str, set] = {}

    def keep(self, filters) -> Iterator:
        for f in filters:
            column = getattr(f, "attribute", (None,))
            if len(column) == 1 and column[0] in ("layer", "kind", "type") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[column[0]] = self.only.get(column[0], values) & values
            else:
                yield f

    def rows(self, path: str) -> Iterator[tuple]:
        import decimal

        names = [n for n in self.names if n != "tile_id"]
        tile = codec.read_tile(_opened(path, self.root), set(names), self.only.get("layer"))
        for r in feature_rows(tile, sorted({*names, *self.only})):
            if all(r[k] in v for k, v in self.only.items()):
                if r.get("id") is not None:
                    r["id"] = decimal.Decimal(r["id"])
                yield tuple(path if n == "tile_id" else r[n] for n in self.names)


class TileReader(_Rows, DataSourceReader):
    def pushFilters(self, filters):
        yield from self.keep(filters)

    def partitions(self):
        paths = [p for p, _ in _listed(self.root)]
        return [_Part(paths[i : i + 64]) for i in range(0, len(paths), 64)] or [_Part([])]

    def read(self, partition):
        for path in partition.paths:
            yield from self.rows(path)


class TileStream(_Rows, DataSourceStreamReader):
    """New files as they are found, whatever their time or name. An offset is the number of a batch; a log names the files of
    each. Option log: a folder for it, which a query needs to go on after a restart; else it is kept in memory."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        super().__init__(schema, options)
        self.log = options.get("log")
        self.batches: list[list[str]] = []
        self.seen: set[str] = set()
        for n in range(1, 1 + len(_listed(self.log, there=False)) if self.log else 1):
            self._add(json.loads(_opened(f"{_root(self.log)}/{n:012}.json", self.log)))

    def _add(self, paths: list[str]) -> None:
        self.batches.append(paths)
        self.seen.update(paths)

    def initialOffset(self):
        return {"batch": 0}

    def latestOffset(self):
        new = [p for p, _ in _listed(self.root) if p not in self.seen]
        if new:
            if self.log:
                _written(f"{_root(self.log)}/{len(self.batches) + 1:012}.json", self.log, json.dumps(new).encode())
            self._add(new)
        return {"batch": len(self.batches)}

    def partitions(self, start, end):
        if end["batch"] > len(self.batches):
            raise ValueError("to go on after a restart, this stream needs the option log, a folder that holds what it has read")
        paths = [p for b in self.batches[start["batch"] : end["batch"]] for p in b]
        return [_Part(paths[i : i + 64]) for i in range(0, len(paths), 64)] or [_Part([])]

    def read(self, partition):
        for path in partition.paths:
            yield from self.rows(path)


class TileSource(DataSource):
    """format("vtile"): features of the tile files under a path. Option columns: a comma-separated list of those wanted."""

    @classmethod
    def name(cls) -> str:
        return "vtile"

    def schema(self) -> T.StructType:
        wanted = self.options.get("columns")
        columns = [c.strip() for c in wanted.split(",")] if wanted else None
        return T.StructType([T.StructField("tile_id", T.StringType()), *model.feature_schema(columns)])

    def reader(self, schema):
        return TileReader(schema, self.options)

    def streamReader(self, schema):
        return TileStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes format("vtile") known and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileSource)


# A parser for SQL


def register_udtf(spark: SparkSession, name: str = "tile_features") -> None:
    """SELECT * FROM tile_features(content): layer, kind, extent, fid, id, type and properties of one tile's features."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=model.PLAIN_FEATURES)
    class TileFeatures:
        def eval(self, content: bytes):
            import decimal

            if content is not None:
                names = model.PLAIN_FEATURES.names
                for r in feature_rows(codec.read_tile(bytes(content), set(names)), names):
                    yield tuple(decimal.Decimal(r[n]) if n == "id" and r[n] is not None else r[n] for n in names)

    spark.udtf.register(name, TileFeatures)
