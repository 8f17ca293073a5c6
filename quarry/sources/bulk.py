"""Tiles between bytes and Arrow columns without a Python object per value: the forms of ``codec`` over whole arrays.

``write_tile`` gives the tile that ``codec.write_tile`` gives for the same features, ``batches`` the rows that
``codec.read_tile`` gives. Where a table or a layer has what the array forms don't cover (missing or empty geometries,
nested properties), they say so by Odd, and the forms of ``codec`` take that layer.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import codec, runs, wire

U64 = np.uint64
LIMITS = np.array([1 << 7 * i for i in range(1, 10)], U64)
BOX_NAMES = ("left", "bottom", "right", "top", "near", "far")
#: Features that are made into a batch at once.
SLICE = 4096
text_of = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


class Odd(Exception):
    """What the array forms don't cover."""


# Varints


def sizes(v: np.ndarray) -> np.ndarray:
    """Bytes of each varint."""
    return np.searchsorted(LIMITS, v, side="right") + 1


def put(v: np.ndarray) -> np.ndarray:
    """Varints one after another."""
    size = sizes(v)
    ends = np.cumsum(size)
    out = np.empty(ends[-1] if len(v) else 0, np.uint8)
    at, left = ends - size, v
    while len(at):
        more = left > 127
        out[at] = (left & U64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        at, left = at[more] + 1, left[more] >> U64(7)
    return out


def bounds(counts: np.ndarray) -> np.ndarray:
    """Offsets of pieces of these lengths, one more than there are pieces."""
    return np.concatenate(([0], np.cumsum(counts))).astype(np.int64)


def per_piece(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the pieces between offsets."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[at[1:]] - total[at[:-1]]


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    at = bounds(counts)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], counts)


def packed_many(pieces: list) -> tuple[np.ndarray, np.ndarray]:
    """The varints of packed pieces, and the offsets of each piece in them."""
    return packed_in(np.frombuffer(b"".join(pieces), np.uint8), bounds(np.fromiter(map(len, pieces), np.int64, len(pieces))))


def packed_in(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of bytes and the pieces' offsets."""
    last = b < 128
    if last.all():
        return b.astype(U64), at
    if not last[at[1:][np.diff(at) > 0] - 1].all():
        raise IndexError("a varint ends with its message")
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = ends - starts + 1
    if width.max() > 10:
        raise ValueError("a varint is longer than ten bytes")
    v = (b[starts] & 127).astype(U64)
    for k in range(1, width.max()):
        there = width > k
        v[there] |= (b[starts[there] + k] & 127).astype(U64) << U64(7 * k)
    return v, np.concatenate(([0], np.cumsum(last)))[at]


def packed_at(entries, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same of a cache's entries, all of them or those with these places."""
    if not isinstance(entries, runs.Entries):
        return packed_many([v for _, v in entries] if index is None else [entries[i][1] for i in index.tolist()])
    starts, size = entries.spans()
    if index is not None:
        index = index.astype(np.int64)
        starts, size = starts[index], size[index]
    return packed_in(np.frombuffer(entries.buffer, np.uint8)[spans(starts, size)], bounds(size))


def numbers_of(raw) -> np.ndarray:
    """A cache's varints."""
    return raw.numbers if isinstance(raw, runs.Entries) and raw.kind == wire.VARINT else np.array([v for _, v in raw], U64)


def scan(pieces: list) -> tuple[np.ndarray, dict[int, tuple]] | None:
    """Messages that all have the same fields in the same order: their bytes, and by tag numbers or (starts, lengths)."""
    at = bounds(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    b = np.frombuffer(b"".join(pieces) + bytes(10), np.uint8)
    p, ends, out = at[:-1], at[1:], {}
    while len(p) and p[0] < ends[0]:
        key = int(b[p[0]])
        if key > 127 or key & 7 not in (wire.VARINT, wire.BYTES) or key >> 3 in out or (p >= ends).any() or (b[p] != key).any():
            return None
        p = p + 1
        v, shift = np.zeros(len(p), U64), 0
        more = np.ones(len(p), bool)
        while more.any():
            if shift > 63 or (p[more] >= ends[more]).any():
                return None
            byte = b[p]
            v[more] |= (byte[more] & 127).astype(U64) << U64(shift)
            p = p + more
            more = more & (byte > 127)
            shift += 7
        if key & 7 == wire.BYTES:
            size = v.astype(np.int64)
            if ((size < 0) | (size > ends - p)).any():
                return None
            out[key >> 3] = p, size
            p = p + size
        else:
            out[key >> 3] = (v,)
    return None if (p != ends).any() else (b, out)


def zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(U64)


def unzigzag(v: np.ndarray) -> np.ndarray:
    return (v >> U64(1)).astype(np.int64) ^ -(v & U64(1)).astype(np.int64)


def steps_in(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Differences within the pieces, the first of each from 0."""
    d = np.diff(v, prepend=0)
    first = at[:-1][np.diff(at) > 0]
    d[first] = v[first]
    return d


def sums_in(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums within the pieces."""
    total = np.concatenate(([0], np.cumsum(v)))
    return total[1:] - np.repeat(total[at[:-1]], np.diff(at))


#: The bits of numbers of 16 bits, two or three places apart; and of as many bits, the first of each two or three.
SPREADS = {n: sum((np.arange(65536, dtype=U64) >> U64(i) & U64(1)) << U64(n * i) for i in range(16)) for n in (2, 3)}
SQUEEZES = {n: sum((np.arange(1 << 4 * n, dtype=U64) >> U64(n * i) & U64(1)) << U64(i) for i in range(4)) for n in (2, 3)}


def weave(axes: list[np.ndarray]) -> np.ndarray:
    """Zigzagged numbers of 16 bits, interleaved."""
    out = np.zeros(len(axes[0]), U64)
    for k, v in enumerate(axes):
        out |= SPREADS[len(axes)][v] << U64(k)
    return out


def unweave(v: np.ndarray, n: int) -> list[np.ndarray]:
    out = []
    for k in range(n):
        a = np.zeros(len(v), U64)
        for i in range(4):
            a |= SQUEEZES[n][(v >> U64(4 * n * i + k)) & U64((1 << 4 * n) - 1)] << U64(4 * i)
        out.append(unzigzag(a))
    return out


# Writing


class Geometry:
    """Geometries of a layer as offsets of features in polygons, polygons in rings, rings in vertices, and coordinates."""

    def __init__(self, column: pa.ListArray) -> None:
        rings, points = column.values, column.values.values
        vertex = points.values
        self.polys, self.rings, self.points = (a.offsets.to_numpy().astype(np.int64) for a in (column, rings, points))
        there = {f.name for f in vertex.type}
        if column.null_count or rings.null_count or points.null_count or vertex.null_count or any(not np.diff(o).all() for o in (self.polys, self.rings, self.points)):
            raise Odd("a geometry with nothing in it")
        self.axes = []
        for c in "xyz":
            a = vertex.field(c) if c in there else None
            if a is None or c == "z":
                a = np.zeros(len(vertex), np.int64) if a is None else pc.fill_null(a, 0).to_numpy(zero_copy_only=False)
            elif a.null_count:
                raise Odd("a vertex without coordinates")
            else:
                a = a.to_numpy()
            if not np.issubdtype(a.dtype, np.integer) or (len(a) and max(abs(int(a.max())), abs(int(a.min()))) >= 1 << 31):
                raise Odd("coordinates that aren't whole numbers of 32 bits")
            self.axes.append(a.astype(np.int64))
        self.m = vertex.field("m") if "m" in there and vertex.field("m").null_count < len(vertex) else None

    def cut(self, a: int, b: int) -> Geometry:
        """That of the features from a to b."""
        out = Geometry.__new__(Geometry)
        out.polys = self.polys[a : b + 1]
        out.rings = self.rings[out.polys[0] : out.polys[-1] + 1]
        out.points = self.points[out.rings[0] : out.rings[-1] + 1]
        p, q = out.points[0], out.points[-1]
        out.axes, out.m = [v[p:q] for v in self.axes], None
        if isinstance(self.m, tuple):
            out.m = self.m[0][p:q], self.m[1]
        elif self.m is not None and self.m[p:q].null_count < q - p:
            out.m = self.m[p:q]
        out.polys, out.rings, out.points = (o - o[0] for o in (out.polys, out.rings, out.points))
        return out


class Layer:
    """Features of one layer as columns."""

    def __init__(self, table: pa.Table, a: int, b: int, geometry: Geometry) -> None:
        n = self.n = b - a
        part = table.slice(a, n)
        col = lambda c: part.column(c).combine_chunks() if c in part.column_names and part.column(c).null_count < n else None
        self.name, self.extent = part.column("layer")[0].as_py(), part.column("extent")[0].as_py() if "extent" in part.column_names else None
        self.extent = self.extent or 4096
        self.types = part.column("type").to_numpy().astype(np.int64)
        ids = col("id")
        self.has_id = np.zeros(n, bool) if ids is None else ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = np.zeros(n, U64) if ids is None else pc.fill_null(ids.cast(pa.uint64()), 0).to_numpy(zero_copy_only=False)
        self.props = objects(part.column("properties").to_pylist()) if "properties" in part.column_names else [{}] * n
        self.offsets, self.boxes = col("offsets"), col("bbox")
        self.indices, self.indices_n = lists_of(col("indices"), n)
        self.corners, self.corners_n = lists_of(col("tessellation"), n)
        self.geometry = geometry.cut(a, b)


class Typed:
    """Rows of scalars as columns, nothing missing: texts are Arrow arrays, others of truth values, int64 or finite float64."""

    def __init__(self, columns: dict[str, np.ndarray | pa.Array], n: int) -> None:
        self.columns, self.n = columns, n

    def __len__(self) -> int:
        return self.n

    def shape(self) -> dict:
        """As infer(rows)."""
        return {k: "string" if isinstance(v, pa.Array) else "bool" if v.dtype == bool else "f64" if v.dtype == float else "i64" if v.min() < 0 else "u64" for k, v in self.columns.items()}

    def rows(self) -> list[dict]:
        lists = [v.to_pylist() if isinstance(v, pa.Array) else v.tolist() for v in self.columns.values()]
        return [dict(zip(self.columns, r)) for r in zip(*lists)] if lists else [{} for _ in range(self.n)]


def typed_rows(columns: dict[str, pa.Array], n: int) -> Typed | list[dict]:
    """Rows of columns of scalars; what is null in a row the row doesn't have. Floats that are all whole are whole numbers."""
    there = {k: v for k, v in columns.items() if v.null_count < n}
    made = {}
    for k, v in there.items():
        if pa.types.is_floating(v.type):
            a = pc.fill_null(v, 0.0).to_numpy(zero_copy_only=False).astype(float)
            if not np.isfinite(a).all():
                raise ValueError(f"{k}: a number that isn't finite")
            made[k] = a.astype(np.int64) if (np.abs(a) < 1 << 53).all() and (a == np.floor(a)).all() else a
        elif pa.types.is_integer(v.type):
            made[k] = pc.fill_null(v, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        elif pa.types.is_boolean(v.type):
            made[k] = pc.fill_null(v, False).to_numpy(zero_copy_only=False)
        elif pa.types.is_string(v.type) or pa.types.is_large_string(v.type):
            made[k] = v
        else:
            raise ValueError(f"{k}: {v.type} is no type of a property here")
    if any(v.null_count for v in there.values()) or any(isinstance(v, np.ndarray) and v.dtype == float and (v == np.floor(v)).all() for v in made.values()):
        return [{k: x for k, x in r.items() if x is not None} for r in pa.Table.from_arrays(list(there.values()), names=list(there)).to_pylist()] if there else [{} for _ in range(n)]
    return Typed(made, n)


def distinct(m: dict[str, pa.Array], n: int) -> tuple[pa.Array, list[dict]] | None:
    """Rows of columns as their places (null where a row has nothing) among the different ones; None where no row has any."""
    if not m or all(v.null_count == n for v in m.values()):
        return None
    code, there = np.zeros(n, np.int64), np.zeros(n, bool)
    for v in m.values():
        coded = v.dictionary_encode()
        there |= v.is_valid().to_numpy(zero_copy_only=False)
        code = pa.array(code * (len(coded.dictionary) + 1) + pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)).dictionary_encode().indices.to_numpy().astype(np.int64)
    coded = pa.array(code, mask=~there).dictionary_encode()
    first = np.zeros(len(coded.dictionary), np.int64)
    places = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    first[places[::-1][places[::-1] >= 0]] = np.flatnonzero(there)[::-1]
    rows = pa.Table.from_arrays([v.take(pa.array(first)) for v in m.values()], names=list(m)).to_pylist()
    return coded.indices, [{k: x for k, x in r.items() if x is not None} for r in rows]


def vertex_layers(table: pa.Table, order: list[str], lone: str, count: str | None, by_type: bool) -> dict[str, Layer]:
    """Layers of a table of vertices: see operators.encode.encode_vertices. by_type: features in the order of columnar layers."""
    n = table.num_rows
    col = lambda c: table.column(c).combine_chunks()
    number = lambda c: pc.fill_null(col(c).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    names = pc.fill_null(col("layer"), "").dictionary_encode()
    in_order = sorted(names.dictionary.to_pylist())
    rank = np.array([in_order.index(v) for v in names.dictionary.to_pylist()])
    layer, fid, types = rank[names.indices.to_numpy()], number("fid"), number("type")
    has_id = np.zeros(n, bool) if "id" not in table.column_names else col("id").is_valid().to_numpy(zero_copy_only=False)
    ids = number("id") if has_id.any() else np.zeros(n, np.int64)
    if not np.isin(types, (1, 2, 4, 5)).all():
        raise ValueError("vertices are of points or lines")
    by = np.lexsort((*[number(c) for c in reversed(order)], types, ids, ~has_id, fid, layer))
    layer, fid, types, ids, has_id = (v[by] for v in (layer, fid, types, ids, has_id))
    begins = (types % 3 == 1) | np.concatenate(([True], (np.diff(layer) != 0) | (np.diff(fid) != 0) | (np.diff(ids) != 0) | (np.diff(types) != 0) | np.diff(has_id)))
    starts = np.flatnonzero(begins)
    size = np.diff(np.append(starts, n))
    alone = (size == 1) & (types[starts] % 3 == 2)
    if lone == "drop" and alone.any():
        stay = np.repeat(~alone, size)
        by, starts, size = by[stay], starts[~alone], size[~alone]
        if not len(by):
            return {}
    layer, types, ids, has_id = (v[starts] for v in (layer, types, ids, has_id))
    if lone == "point":
        types = np.where(alone, types - 1, types)
    starts = bounds(size)[:-1]
    if by_type and len(types) and (np.diff(layer * 8 + types) < 0).any():
        again = np.lexsort((types, layer))
        by, starts = by[spans(starts[again], size[again])], bounds(size[again])[:-1]
        layer, types, ids, has_id, size = (v[again] for v in (layer, types, ids, has_id, size))
    head = by[starts]
    axes = []
    for c in "xyz":
        a = col(c) if c in table.column_names else None
        if a is not None and c != "z" and a.null_count:
            raise ValueError("a vertex without coordinates")
        a = np.zeros(n, np.int64) if a is None else number(c)
        if len(a) and max(abs(int(a.max())), abs(int(a.min()))) >= 1 << 31:
            raise ValueError("coordinates that aren't of 32 bits")
        axes.append(a[by])
    points, out = bounds(size), {}
    props, ms = ({c[2:]: col(c) for c in table.column_names if c.startswith(p)} for p in ("p:", "m:"))
    for k, name in enumerate(in_order):
        a, b = np.searchsorted(layer, (k, k + 1)).tolist()
        if a == b:
            continue
        x, rows = Layer.__new__(Layer), pa.array(head[a:b])
        x.n, x.name, x.types, x.has_id, x.ids = b - a, name, types[a:b], has_id[a:b], ids[a:b].astype(U64)
        extent = col("extent")[int(head[a])].as_py() if "extent" in table.column_names else None
        x.extent = extent or 4096
        columns = {c: v.take(rows) for c, v in props.items()}
        if count is not None:
            lines = pa.array(x.types % 3 == 2)
            columns[count] = pc.if_else(lines, pa.array(size[a:b]), columns[count].cast(pa.int64()) if count in columns else pa.scalar(None, pa.int64()))
        x.props = typed_rows(columns, x.n)
        x.boxes = x.indices = x.corners = x.offsets = None
        x.indices_n = x.corners_n = np.zeros(x.n, np.int64)
        if "offset" in table.column_names and col("offset").null_count < n:
            flat = pc.fill_null(col("offset").take(rows), 0.0)
            each = pa.array(np.arange(x.n + 1), pa.int32())
            x.offsets = pa.ListArray.from_arrays(each, pa.ListArray.from_arrays(each, flat))
        g = x.geometry = Geometry.__new__(Geometry)
        g.polys = g.rings = np.arange(x.n + 1)
        p, q = points[a], points[b]
        g.points, g.axes = points[a : b + 1] - p, [v[p:q] for v in axes]
        g.m = distinct({c: v.take(pa.array(by[p:q])) for c, v in ms.items()}, q - p)
        out[name] = x
    return out


def lists_of(column: pa.ListArray | None, n: int) -> tuple[pa.Array | None, np.ndarray]:
    """The values of n lists (None: empty) and how many each has."""
    if column is None:
        return None, np.zeros(n, np.int64)
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def whole(column: pa.Array) -> np.ndarray:
    """A column of whole numbers, all there."""
    if column.null_count or not pa.types.is_integer(column.type):
        raise Odd("a list with something else than whole numbers")
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def corner_axes(corners: pa.StructArray, names: str) -> list[np.ndarray]:
    there = {f.name for f in corners.type}
    if corners.null_count:
        raise Odd("a corner that is missing")
    return [whole(corners.field(c)) if c != "z" else whole(pc.fill_null(corners.field(c), 0)) if c in there else np.zeros(len(corners), np.int64) for c in names]


class Rows(list):
    """Rows that stay as they are, so that their columns are put together once."""

    @cached_property
    def names(self) -> tuple | None:
        """The keys that all rows have in this order, if they do."""
        found = set(map(tuple, self))
        return found.pop() if len(found) == 1 else None

    @cached_property
    def columns(self) -> list[tuple]:
        return list(zip(*map(dict.values, self)))


def objects(texts: list) -> Rows:
    """JSON texts as Python values, {} where there is none; parsed at once."""
    out = json.loads(f"[{','.join([t or '{}' for t in texts])}]")
    if len(out) != len(texts) or any(type(v) is not dict for v in out):
        raise Odd("properties that are no objects")
    return Rows(out)


def layers(table: pa.Table) -> Iterator[tuple[int, int]]:
    """First row and end of each layer of a table that is sorted by layer."""
    names = table.column("layer").combine_chunks().dictionary_encode().indices.to_numpy()
    at = [0, *(np.flatnonzero(np.diff(names)) + 1).tolist(), len(names)]
    return zip(at[:-1], at[1:])


def by_type(table: pa.Table) -> pa.Table:
    """Within each layer by type, then in the order they had, as columnar layers have them."""
    types = table.column("type").to_numpy()
    if all((np.diff(types[a:b]) >= 0).all() for a, b in layers(table)):
        return table
    return table.take(pa.array(np.concatenate([a + np.argsort(types[a:b], kind="stable") for a, b in layers(table)])))


def write_tile(table: pa.Table, kind: str, shapes: dict[str, tuple], always=()) -> bytes:
    """The tile of a table sorted by layer and place within it; raises Odd where the array forms don't cover it."""
    if "geometry" not in table.column_names or table.column("layer").null_count or table.column("type").null_count or not table.num_rows:
        raise Odd("features without layer, type or geometry")
    if kind == "open":
        table = by_type(table)
    try:
        geometry = Geometry(table.column("geometry").combine_chunks())
        made = {x.name: x for a, b in layers(table) for x in [Layer(table, a, b, geometry)]}
    except pa.ArrowInvalid as e:
        raise Odd(str(e)) from e
    if any(x.types.min() < 1 or x.types.max() > 6 for x in made.values()):
        raise Odd("a type that isn't one of six")
    return write_layers(made, kind, shapes, always)


def write_layers(made: dict[str, Layer], kind: str, shapes: dict[str, tuple], always=()) -> bytes:
    out, cache = bytearray(), Columns()
    for name in sorted({*made, *always}):
        x = made.get(name)
        if x is None:
            shape, mshape = shapes.get(name, (None, None))
            bare = {"layer": name, "extent": 4096, "shape": shape, "mshape": mshape, "features": []}
            body = codec.write_open_layer(bare, cache) if kind == "open" else codec.write_mvt_layer(bare, kind == "mvt")
        else:
            body = open_layer(x, *shapes.get(name, (None, None)), cache) if kind == "open" else mvt_layer(x, kind == "mvt")
        wire.put_bytes(out, {"open": codec.OPEN, "mvt": codec.MVT, "flat": codec.FLAT}[kind], body)
    if kind == "open":
        wire.put_bytes(out, codec.CACHE, cache.write())
    return bytes(out)


def rewrite(found: list[dict], kind: str, skip: bool) -> bytes:
    """A tile of layers whose features are messages; skip: without those that are columnar."""
    kept = [x for x in found if not skip or x["kind"] != "open"]
    names = [x["layer"] for x in kept]
    if not kept or names != sorted(set(names)) or any(not x["n_features"] or (x["kind"] == "open" and x["version"] != 1) for x in kept):
        raise Odd("layers that are empty or out of order")
    schema = pa.schema([f for f in arrow_features() if f.name != "kind"])
    table = pa.Table.from_batches([b for x in kept for b in layer_batches(x, schema, {})], schema)
    return write_tile(table, kind, {x["layer"]: (x["shape"] if x["kind"] == "open" else None, x["mshape"]) for x in kept})


@cache
def arrow_features() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    from . import model

    made = to_arrow_schema(model.FEATURES)
    return made.set(made.get_field_index("id"), pa.field("id", pa.uint64()))


def messages(tag: int, n: int, blocks: list[tuple]) -> bytes:
    """n messages with this tag. Blocks, in their order within each: (tag, where, values) a number, (tag, where, values,
    counts) a packed list, counts of them each; tag 0: a number by itself. where: in which messages, None for all."""
    everywhere = np.ones(n, bool)
    count, size, laid = np.full(n, 2), np.zeros(n, np.int64), []
    for t, where, values, *counts in blocks:
        where = everywhere if where is None else where
        values = values.astype(U64)
        if counts:
            at = bounds(counts[0])
            inner = per_piece(sizes(values), at)
            laid.append((t, where, values, counts[0], inner, count.copy()))
            count += np.where(where, 2 + counts[0], 0)
            size += np.where(where, 1 + sizes(inner.astype(U64)) + inner, 0)
        else:
            laid.append((t, where, values, None, None, count.copy()))
            count += np.where(where, 1 + (t > 0), 0)
            size += np.where(where, (t > 0) + sizes(values), 0)
    at = bounds(count)
    out = np.empty(at[-1], U64)
    out[at[:-1]], out[at[:-1] + 1] = tag << 3 | 2, size
    for t, where, values, counts, inner, place in laid:
        p = (at[:-1] + place)[where]
        if counts is None:
            if t:
                out[p] = t << 3
            out[p + (t > 0)] = values[where]
        else:
            out[p], out[p + 1] = t << 3 | 2, inner[where]
            out[spans(p + 2, counts[where])] = values
    return put(out).tobytes()


def commands(forms: np.ndarray, g: Geometry, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """Command streams of all features and the length of each; see codec.geometry_commands."""
    ring_form = np.repeat(np.repeat(forms, np.diff(g.polys)), np.diff(g.rings))
    whole = np.diff(g.points)
    body = whole - ((ring_form == 3) & (whole > 1))
    x, y = (a[spans(g.points[:-1], body)] for a in g.axes[:2])
    starts = bounds(body)
    of_feature = starts[g.rings[g.polys]]  # offsets of features in vertices
    dx, dy = zigzag(steps_in(x, of_feature)), zigzag(steps_in(y, of_feature))
    before = np.repeat(ring_form == 1, body).astype(np.int64)
    what = np.full(len(x), 9, np.int64)
    line = ring_form != 1
    before[starts[:-1][line]] = 1
    more = line & (body > 1)
    before[starts[:-1][more] + 1], what[starts[:-1][more] + 1] = 1, (body[more] - 1) << 3 | 2
    after = np.zeros(len(x), np.int64)
    closes = ring_form == 3
    after[starts[1:][closes] - 1] = 1
    if not plain:
        ends = np.zeros(len(body), bool)
        ends[g.rings[1:] - 1] = True
        after[starts[1:][closes & ends] - 1] = 2
    at = bounds(2 + before + after)
    out = np.empty(at[-1], U64)
    p = at[:-1]
    out[p[before > 0]] = what[before > 0]
    p = p + before
    out[p], out[p + 1] = dx, dy
    out[p[after > 0] + 2] = 15
    out[p[after > 1] + 3] = 12
    return out, np.diff(at[of_feature])


def varint(n: int) -> bytes:
    out = bytearray()
    wire.put_varint(out, n)
    return bytes(out)


def scalars(column) -> list:
    """Values told apart as a layer's values are: truth values in tuples, all but scalars as JSON texts."""
    if set(map(type, column)) <= {str, int, float}:
        return column
    return [(v,) if type(v) is bool else v if type(v) in (str, int, float) else text_of(v) for v in column]


def mvt_layer(x: Layer, plain: bool) -> bytes:
    """As codec.write_mvt_layer."""
    out = bytearray()
    wire.put(out, 15, 1 if plain else 5)
    wire.put_text(out, 1, x.name or "")
    wire.put(out, 5, x.extent)
    if isinstance(x.props, Typed):
        counts, pairs, keys, value_bytes = typed_pairs(x.props)
    else:
        counts, pairs, keys, value_bytes = listed_pairs(x)
    at = bounds(2 * counts)
    for a in range(0, x.n, SLICE):
        b = min(a + SLICE, x.n)
        out += mvt_features(x, a, b, pairs[at[a] : at[b]], 2 * counts[a:b], plain)
    for k in keys:
        wire.put_text(out, 3, k)
    return bytes(out + value_bytes)


def mvt_features(x: Layer, a: int, b: int, pairs: np.ndarray, counts: np.ndarray, plain: bool) -> bytes:
    """The messages of the features from a to b: a layer is written some thousands at a time, so that only they are in arrays."""
    tags = (1, 2, 3, 4, 5, 6) if plain else (15, 1, 2, 3, 4, 5)
    forms = (x.types[a:b] - 1) % 3 + 1
    blocks = [(tags[0], x.has_id[a:b], x.ids[a:b]), (tags[1], None, pairs, counts), (tags[2], None, forms if plain else np.where(forms < 3, forms, 4)), (tags[3], None, *commands(forms, x.geometry.cut(a, b), plain))]
    for tag, values, lengths, width in ((tags[4], x.indices, x.indices_n, 1), (tags[5], x.corners, x.corners_n, 2)):
        if values is not None:
            n, first = lengths[a:b], int(lengths[:a].sum())
            values, at = values.slice(first, int(n.sum())), bounds(n)
            axes = [whole(values)] if width == 1 else corner_axes(values, "xy")
            blocks.append((tag, n > 0, np.stack([zigzag(steps_in(v, at)) for v in axes], axis=1).ravel(), width * n))
    return messages(2, b - a, blocks)


def typed_pairs(t: Typed) -> tuple[np.ndarray, np.ndarray, list[str], bytes]:
    """How many values each row has, places of keys and values in turn, keys, and the values' messages in the order of their
    first use. Values are told apart by kind, over all columns of a kind at once."""
    n, names = t.n, list(t.columns)
    codes, made, base = np.zeros((n, len(names)), np.int64), [], 0
    parts: dict[int, list] = {0: [], 1: [], 2: [], 3: []}  # texts, truth values, whole numbers, others
    for i, v in enumerate(t.columns.values()):
        if isinstance(v, pa.Array):
            parts[0].append((i, slice(None), v.cast(pa.string())))
        elif v.dtype == float:
            whole = (v == np.floor(v)) & (np.abs(v) < 1 << 53)
            parts[2].append((i, whole, pa.array(v[whole].astype(np.int64))))
            parts[3].append((i, ~whole, pa.array(v[~whole])))
        else:
            parts[1 if v.dtype == bool else 2].append((i, slice(None), pa.array(v)))
    for kind, columns in parts.items():
        if columns:
            coded = pa.concat_arrays([v for *_, v in columns]).dictionary_encode()
            at, found = 0, coded.indices.to_numpy()
            for i, where, v in columns:
                codes[where, i] = found[at : at + len(v)] + base
                at += len(v)
            base += len(coded.dictionary)
            made.append((kind, coded.dictionary))
    seen = pa.array(codes.ravel()).dictionary_encode()
    pairs = np.stack([np.tile(np.arange(len(names)), n), seen.indices.to_numpy()], axis=1).ravel()
    order, out, base = seen.dictionary.to_numpy(), [], 0
    numbers = np.zeros(len(order), bool)
    values = np.zeros(len(order), U64)
    other: dict[int, object] = {}
    for kind, v in made:
        here = np.flatnonzero((order >= base) & (order < base + len(v)))
        local = v.take(pa.array(order[here] - base))
        if kind == 2:
            local = local.to_numpy()
            fits = local >= 0
            numbers[here[fits]], values[here[fits]] = True, local[fits].astype(U64)
            here, local = here[~fits], local[~fits].tolist()
            other |= dict(zip(here.tolist(), local))
        else:
            other |= dict(zip(here.tolist(), local.to_pylist()))
        base += len(v)
    data, at = messages(4, int(numbers.sum()), [(5, None, values[numbers])]), np.zeros(len(order) + 1, np.int64)
    at[1:] = np.cumsum(np.where(numbers, 3 + sizes(values), 0))
    last = 0
    for i in sorted(other):
        piece = bytearray()
        wire.put_bytes(piece, 4, codec.write_mvt_value(other[i]))
        out += [data[last : at[i]], bytes(piece)]
        last = at[i]
    out.append(data[last:])
    return np.full(n, len(names)), pairs, names, b"".join(out)


def listed_pairs(x: Layer) -> tuple[np.ndarray, np.ndarray, list[str], bytes]:
    """The same of rows that are Python values."""
    out = bytearray()
    counts = np.fromiter(map(len, x.props), np.int64, x.n)
    names = list(x.props[0])
    if alike(x.props, names):
        found = [scalars(c) for c in columns_of(x.props, names)]
        keys, flat = dict(zip(names, range(len(names)))), list(chain.from_iterable(zip(*found)))
        key_at = np.tile(np.arange(len(names)), x.n)
    else:
        flat = scalars(list(chain.from_iterable(d.values() for d in x.props)))
        keys = {k: i for i, k in enumerate(dict.fromkeys(chain.from_iterable(x.props)))}
        key_at = np.fromiter(map(keys.__getitem__, chain.from_iterable(x.props)), np.int64, len(flat))
    values = dict.fromkeys(flat)
    place = dict(zip(values, range(len(values))))
    pairs = np.stack([key_at, np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))], axis=1).ravel()
    plain_ints = [v for v in values if type(v) is int and 0 <= v <= wire.MASK64]
    numbers = np.fromiter(plain_ints, U64, len(plain_ints))
    data, at = messages(4, len(numbers), [(5, None, numbers)]), bounds(3 + sizes(numbers)).tolist()
    ready = iter([data[a:b] for a, b in zip(at[:-1], at[1:])])
    for v in values:
        if type(v) is int and 0 <= v <= wire.MASK64:
            out += next(ready)
        else:
            wire.put_bytes(out, 4, codec.write_mvt_value(v[0] if type(v) is tuple else v))
    return counts, pairs, list(keys), bytes(out)


# Columns of the columnar format

#: Default, and what makes a value one of the column's, by a scalar's type; and the types of values that need no making.
SCALARS = {"string": ("", str, {str}), "u64": (0, int, {int}), "i64": (0, int, {int}), "f64": (0.0, float, {float}), "bool": (0, int, {int})}
TAKES = {"string": {str, type(None)}, "u64": {int, float, type(None)}, "i64": {int, float, type(None)}, "f64": {int, float, type(None)}, "bool": {bool, type(None)}}


def alike(rows: list[dict], keys: list[str]) -> bool:
    """Whether all rows have these keys in this order."""
    if isinstance(rows, Rows):
        return not rows or rows.names == tuple(keys)
    return set(map(tuple, rows)) <= {tuple(keys)}


def columns_of(rows: list[dict], keys: list[str]) -> list[tuple]:
    if alike(rows, keys):
        return [] if not keys else rows.columns if isinstance(rows, Rows) else list(zip(*map(dict.values, rows)))
    return [tuple([d.get(k) for d in rows]) for k in keys]


def infer(rows: list[dict]) -> dict:
    """As codec.infer."""
    keys = list(rows[0]) if rows else []
    if not alike(rows, keys):
        return codec.infer(rows)
    out = {}
    for k, column in zip(keys, columns_of(rows, keys)):
        kinds = set(map(type, column))
        if kinds == {str}:
            out[k] = "string"
        elif kinds == {bool}:
            out[k] = "bool"
        elif kinds <= {int, float}:
            whole = all(v.is_integer() for v in column if type(v) is float) if float in kinds else True
            out[k] = "f64" if not whole else "i64" if min(column) < 0 else "u64"
        else:
            return codec.infer(rows)
    return out


class Signature(tuple):
    """Columns of a row of values; stands before the values as the first part of its key."""

    __slots__ = ()


class Columns(codec.Columns):
    """Rows of scalars are kept as they are, rings and lists of indices as their bytes; rows of typed columns as the bytes of
    int64: the place of their signature, then their values."""

    def __init__(self) -> None:
        super().__init__()
        self.signs: dict[Signature, int] = {}
        self.counted: dict[int, list[np.ndarray]] = {c: [] for c in self.numbers}
        #: Different pieces of the columns that one layer has used so far, not yet among the lists.
        self.fresh: dict[int, pa.Array] = {}

    def piece_places(self, column: int, pieces: pa.Array) -> np.ndarray:
        """Places of pieces that are all different."""
        known = self.lists[column]
        if not known and column not in self.fresh:
            self.fresh[column] = pieces
            return np.arange(len(pieces))
        if column in self.fresh:
            known.update(zip(self.fresh.pop(column).to_pylist(), range(1 << 62)))
        return np.array([known.setdefault(b, len(known)) for b in pieces.to_pylist()], np.int64)

    def typed_rows(self, t: Typed, shape: dict) -> list[bytes] | None:
        """As rows; None where a column isn't of the shape's type."""
        if list(shape) != list(t.columns) or not t.columns or any(k not in TAKES or (k == "string") != isinstance(v, pa.Array) or (k == "bool") != (not isinstance(v, pa.Array) and v.dtype == bool) or (k in ("u64", "i64") and v.dtype != np.int64) or (k == "u64" and v.min() < 0) for k, v in zip(shape.values(), t.columns.values())):
            return None
        sign = Signature(0 if k == "string" else codec.COLUMN_OF[k] for k in shape.values())
        made = np.empty((t.n, 1 + len(sign)), np.int64)
        made[:, 0] = self.signs.setdefault(sign, len(self.signs))
        for i, (c, v) in enumerate(zip(sign, t.columns.values()), 1):
            if not c:
                coded = v.dictionary_encode()
                made[:, i] = np.array([self.add(codec.STRING, x) for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            elif c == codec.F64:
                v = v.astype(float) + 0.0
                self.counted[c].append(v)
                made[:, i] = v.view(np.int64)
            else:
                made[:, i] = v
                self.counted[c].append(made[:, i].copy())
        data, width = made.tobytes(), 8 * made.shape[1]
        return [data[k : k + width] for k in range(0, len(data), width)]

    def rows(self, rows: list[dict], shape, times: list[int] | None = None) -> list[tuple]:
        """All rows as their keys among the shapes; times: how often each is used, once where it isn't given."""
        if isinstance(rows, Typed):
            found = self.typed_rows(rows, shape) if codec.is_flat(shape) else None
            if found is not None:
                return found
            rows = rows.rows()
        keys = list(shape) if codec.is_flat(shape) else []
        found = columns_of(rows, keys)
        kinds = [set(map(type, c)) for c in found]
        if not keys or any(t not in TAKES or not k <= TAKES[t] for t, k in zip(shape.values(), kinds)):
            return [[self.row(r, shape) for _ in range(k)][0] for r, k in zip(rows, times or [1] * len(rows))]
        made = []
        for t, column, kind in zip(shape.values(), found, kinds):
            default, make, ready = SCALARS[t]
            if not kind <= ready:
                column = [default if v is None else make(v) for v in column]
            if t == "string":
                column = [self.add(codec.STRING, v) for v in column]
            else:
                count = self.numbers[codec.COLUMN_OF[t]]
                for v, n in Counter(column).items() if times is None else zip(column, times):
                    count[v] = count.get(v, 0) + n
            made.append(column)
        sign = Signature(0 if t == "string" else codec.COLUMN_OF[t] for t in shape.values())
        return list(zip([sign] * len(rows), *made))

    def ranked(self, column: int) -> tuple[list | np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Numbers by how often they are used; and, where they are arrays, in order of value with the place of each."""
        n, arrays = self.numbers[column], self.counted[column]
        kind = float if column in (codec.F32, codec.F64) else np.int64
        try:
            v = np.fromiter(n, kind, len(n))
            if kind is float and np.isnan(v).any():
                raise OverflowError
        except OverflowError:
            for a in arrays:
                for x, k in Counter(a.tolist()).items():
                    n[x] = n.get(x, 0) + k
            arrays.clear()
            return sorted(n, key=lambda v: (-n[v], v)), None, None
        v, of = np.unique(np.concatenate((v, *arrays)), return_inverse=True)
        times = np.bincount(of, np.concatenate((np.fromiter(n.values(), np.int64, len(n)), *[np.ones(len(a), np.int64) for a in arrays]))).astype(np.int64) if len(v) else np.zeros(0, np.int64)
        order = np.lexsort((v, -times))
        place = np.empty(len(v), np.int64)
        place[order] = np.arange(len(v))
        return v[order], v, place

    def write(self) -> bytes:
        out = bytearray()
        for s in self.lists[codec.STRING]:
            wire.put_text(out, codec.STRING, s)
        rank, places = {}, {}
        for c in (codec.U64, codec.I64, codec.F32, codec.F64):
            order, values, place = self.ranked(c)
            values = None if values is None else (values, place)
            places[c] = values
            if c in (codec.F32, codec.F64):
                for v in order:
                    (wire.put_float if c == codec.F32 else wire.put_double)(out, c, v)
            elif len(order):
                tokens = np.empty(2 * len(order), U64)
                numbers = order if values is not None else np.array([v & wire.MASK64 for v in order], U64) if c == codec.U64 else np.array(order, np.int64)
                tokens[::2], tokens[1::2] = c << 3, numbers.astype(U64) if c == codec.U64 else zigzag(numbers)
                out += put(tokens).tobytes()
            rank[c] = order
        for c in (codec.POINTS, codec.POINTS3D, codec.INDICES):
            if c in self.fresh:
                out += piece_fields(c, self.fresh[c])
                continue
            lengths = list(map(len, self.lists[c]))
            heads = {n: bytes((c << 3 | 2,)) + varint(n) for n in set(lengths)}
            out += b"".join(chain.from_iterable(zip(map(heads.__getitem__, lengths), self.lists[c])))
        out += self.shapes_bytes(rank, places)
        return bytes(out + box_fields(list(self.lists[codec.BBOXES])))

    def shapes_bytes(self, rank: dict, places: dict) -> bytes:
        """All rows by arrays: those of a signature at once, each where it belongs."""
        shapes = list(self.lists[codec.SHAPES])
        dicts: dict[int, dict] = {}

        def of(c: int) -> dict:
            if c not in dicts:
                order = rank[c] if isinstance(rank[c], list) else rank[c].tolist()
                dicts[c] = dict(zip(order, range(len(order))))
            return dicts[c]

        kinds = [x[:8] if type(x) is bytes else x[0] if x and type(x[0]) is Signature else None for x in shapes]
        groups: dict[object, list[int]] = {}
        for i, k in enumerate(kinds):
            groups.setdefault(k, []).append(i)
        signs, counts, made = list(self.signs), np.zeros(len(shapes), np.int64), []
        for k, at in groups.items():
            rows = [shapes[i] for i in at]
            if k is None:
                for i, x in zip(at, rows):
                    tokens = [v if isinstance(v, int) else of(v[0])[v[1]] for v in x]
                    counts[i] = len(tokens)
                    made.append(([i], len(tokens), np.array(tokens, np.int64)))
                continue
            if type(k) is bytes:
                sign = signs[int.from_bytes(k, "little")]
                flat = np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), -1)[:, 1:]
                tokens = np.empty(flat.shape, np.int64)
                for j, c in enumerate(sign):
                    v = flat[:, j]
                    if not c:
                        tokens[:, j] = v
                    elif places[c] is None:
                        tokens[:, j] = [of(c)[x] for x in v.tolist()]
                    else:
                        v = np.ascontiguousarray(v).view(float) if c == codec.F64 else v
                        tokens[:, j] = places[c][1][np.searchsorted(places[c][0], v)]
            else:
                values = [map(of(c).__getitem__, column) if c else column for c, column in zip(k, list(zip(*rows))[1:])]
                sign, tokens = k, np.array([np.fromiter(v, np.int64, len(rows)) for v in values]).T
            counts[at] = len(sign)
            made.append((at, len(sign), tokens.ravel()))
        starts = bounds(counts)
        flat = np.empty(starts[-1], np.int64)
        for at, width, tokens in made:
            flat[spans(starts[np.array(at)], np.full(len(at), width))] = tokens
        return packed_fields(codec.SHAPES, flat, counts) if len(shapes) else b""


def packed_fields(tag: int, values: np.ndarray, counts: np.ndarray) -> bytes:
    """One packed list after another, each with this tag."""
    at = bounds(counts)
    inner = per_piece(sizes(values.astype(U64)), at)
    to = bounds(counts + 2)
    out = np.empty(to[-1], U64)
    out[to[:-1]], out[to[:-1] + 1] = tag << 3 | 2, inner
    out[spans(to[:-1] + 2, counts)] = values
    return put(out).tobytes()


def piece_fields(tag: int, pieces: pa.Array) -> bytes:
    """Pieces (an array of large binaries) one after another, each with this tag."""
    at = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)
    size = np.diff(at)
    heads = np.empty(2 * len(size), U64)
    heads[::2], heads[1::2] = tag << 3 | 2, size
    head = 1 + sizes(heads[1::2])
    to = bounds(head + size)
    out = np.empty(to[-1], np.uint8)
    out[spans(to[:-1], head)] = put(heads)
    if to[-1] > len(heads):
        out[spans(to[:-1] + head, size)] = np.frombuffer(pieces.buffers()[2], np.uint8)[at[0] : at[-1]]
    return out.tobytes()


SPANS = np.array((180.0, 90.0, 180.0, 90.0))


def box_fields(boxes: list[tuple]) -> bytes:
    """A cache's boxes as codec.box_bytes gives them, all at once."""
    size = np.fromiter(map(len, boxes), np.int64, len(boxes))
    if len(boxes) and ((size == 4) | (size == 6)).all():
        v = np.array([(*b, 0.0, 0.0)[:6] for b in boxes], float)
        q = np.floor((v[:, :4] + SPANS) * codec.MAX24 / (2 * SPANS) + 0.5)
        if (np.abs(q) < 1 << 53).all() and (np.abs(v[:, 4:]) < 3e38).all():
            q = q.astype(np.int64) & codec.MAX24
            out = np.empty((len(boxes), 22), np.uint8)
            out[:, 0], out[:, 1] = codec.BBOXES << 3 | 2, np.where(size == 6, 20, 12)
            out[:, 2:14:3], out[:, 3:14:3], out[:, 4:14:3] = q >> 16, q >> 8 & 255, q & 255
            out[:, 14:] = v[:, 4:].astype("<f4").view(np.uint8)
            return out[np.arange(22) < out[:, 1:2].astype(np.int64) + 2].tobytes()
    made = bytearray()
    for b in boxes:
        wire.put_bytes(made, codec.BBOXES, codec.box_bytes(list(b)))
    return bytes(made)


def box_places(boxes: pa.StructArray, there: np.ndarray, found: dict) -> np.ndarray:
    """Places among the boxes found of those that are there."""
    axes = [boxes.field(c).filter(pa.array(there)) for c in BOX_NAMES]
    deep = axes[4].is_valid().to_numpy(zero_copy_only=False)
    v = np.stack([pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False) for a in axes], axis=1)
    if any(a.null_count for a in axes[:4]) or axes[4].is_valid() != axes[5].is_valid() or np.isnan(v).any():
        return np.array([found.setdefault(tuple([x for x in b if x is not None]), len(found)) for b in zip(*[a.to_pylist() for a in axes])], np.int64)
    rows = np.ascontiguousarray(np.column_stack((v + 0.0, deep)))
    coded = pa.Array.from_buffers(pa.binary(56), len(rows), [None, pa.py_buffer(rows)]).dictionary_encode()
    codes, first = coded.indices.to_numpy(), np.zeros(len(coded.dictionary), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    made = [tuple(b if d else b[:4]) for b, d in zip(v[first].tolist(), deep[first].tolist())]
    return np.array([found.setdefault(b, len(found)) for b in made], np.int64)[codes]


def open_layer(x: Layer, shape, mshape, cache: Columns) -> bytes:
    """As codec.write_open_layer, of features that are ordered by type."""
    g, n = x.geometry, x.n
    shape = shape or (x.props.shape() if isinstance(x.props, Typed) else infer(x.props))
    vertices = g.points[g.rings[g.polys]]
    of_m, ms = None, []
    if g.m is not None:
        if isinstance(g.m, tuple):
            of_m, ms = g.m
        else:
            coded = g.m.dictionary_encode()
            of_m, ms = coded.indices, objects(coded.dictionary.to_pylist())
        if mshape is None:
            mshape = infer(ms)
        there = of_m.is_valid().to_numpy(zero_copy_only=False)
        has_m = per_piece(there.astype(np.int64), vertices) > 0
    else:
        has_m = np.zeros(n, bool)
    codec.check_shape(shape)
    out = bytearray()
    wire.put(out, 1, 1)
    wire.put(out, 2, cache.add(codec.STRING, x.name or ""))
    wire.put(out, 3, codec.EXTENTS.index(x.extent))
    wire.put(out, 5, cache.shape(shape))
    if mshape is not None:
        wire.put(out, 6, cache.shape(mshape))
    three, form = x.types > 3, (x.types - 1) % 3 + 1
    n_polys, n_rings = np.diff(g.polys), np.diff(g.rings[g.polys])
    first_ring = g.rings[g.polys[:-1]]
    size = np.diff(g.points)
    single = np.where(form == 1, size[first_ring], np.where(form == 2, n_rings, n_polys)) == 1
    lone = single & (form == 1)
    codes = woven(g.axes, g.points, np.repeat(three, np.diff(vertices)))
    where = np.zeros(n, np.int64)
    where[lone] = codes[g.points[first_ring[lone]]]
    known = cache.lists[codec.SHAPES]
    rows = cache.rows(x.props, shape)
    has_offsets, boxes, index, corners = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    has_index, has_corners, has_box = (x.indices_n > 0) & (form == 3), (x.corners_n > 0) & (form == 3), np.zeros(n, bool)
    if lone.all():
        props = np.fromiter((known.setdefault(r, len(known)) for r in rows), np.int64, n)
    else:
        # A list of indices has: how many parts there are, unless it is one; of a polygon how many rings; and of each ring
        # its offset, its place in the cache and its m-values.
        of_ring = np.repeat(np.arange(n), n_rings)
        of_poly = np.repeat(np.arange(len(g.rings) - 1), np.diff(g.rings))
        nth = np.arange(len(of_ring)) - first_ring[of_ring]
        r = np.flatnonzero(~lone[of_ring] & ((form[of_ring] > 1) | (nth == 0)))
        f, poly, nth = of_ring[r], of_poly[r], nth[r]
        in_poly = r - g.rings[:-1][poly]
        count_m = np.where(has_m[f], size[r], 0)
        props, m_at = places(cache, rows, ms, of_m, mshape, g.points[:-1][r], count_m, f)
        has_offsets, offset = offsets_at(x.offsets, n, f, np.where(form[f] == 3, poly - g.polys[f], 0), np.where(form[f] == 3, in_poly, nth))
        has_offsets &= form > 1
        tells, counts, off = (nth == 0) & ~single[f] & (form[f] > 1), (in_poly == 0) & (form[f] == 3), has_offsets[f]
        if (offset[off] < 0).any():
            raise ValueError("an offset must not be negative")
        ring_codes = codes[spans(g.points[:-1][r], size[r])]
        corner_codes, corner_n = np.zeros(0, U64), np.where(has_corners, x.corners_n, 0)
        if has_corners.any():
            pick = np.repeat(has_corners, x.corners_n)
            corner_codes = woven([v[pick] for v in corner_axes(x.corners, "xyz")], bounds(corner_n), np.repeat(three, corner_n))
        ring_at, made = np.empty(len(r), np.int64), np.flatnonzero(has_corners)
        for d, column in ((False, codec.POINTS), (True, codec.POINTS3D)):
            a, b = three[f] == d, three[made] == d
            if a.any():
                ring_at[a], corners[made[b]] = kept(cache, column, (f[a], ring_codes[np.repeat(a, size[r])], size[r][a]), (made[b], corner_codes[np.repeat(b, corner_n[made])], corner_n[made][b]))
        at = bounds(tells.astype(np.int64) + counts + off + 1 + count_m)
        listed, p = np.empty(at[-1], np.int64), at[:-1].copy()
        listed[p[tells]] = np.where(form == 2, n_rings, n_polys)[f[tells]]
        p += tells
        listed[p[counts]] = np.diff(g.rings)[poly[counts]]
        p += counts
        listed[p[off]] = np.floor(offset[off] * 1000).astype(np.int64)
        p += off
        listed[p] = ring_at
        listed[spans(p + 1, count_m)] = m_at
        begins = np.flatnonzero(np.diff(f, prepend=-1))
        ends = np.append(at[begins], at[-1])
        made, index_n = np.flatnonzero(has_index), np.where(has_index, x.indices_n, 0)
        more = whole(x.indices)[np.repeat(has_index, x.indices_n)] if len(made) else np.zeros(0, np.int64)
        where[f[begins]], index[made] = kept(cache, codec.INDICES, (f[begins], zigzag(steps_in(listed, ends)), np.diff(ends)), (made, zigzag(steps_in(more, bounds(index_n))), index_n[made]))
    if x.boxes is not None:
        has_box = x.boxes.is_valid().to_numpy(zero_copy_only=False)
        boxes[has_box] = box_places(x.boxes, has_box, cache.lists[codec.BBOXES])
    # A lone point says that it has m-values, though none are stored.
    flags = sum(v.astype(np.int64) << k for k, v in enumerate((x.has_id, has_box, has_offsets, has_index, has_corners, has_m, single)))
    blocks = [(None, x.types), (None, flags), (x.has_id, x.ids), (None, props), (None, where), (has_index, index), (has_corners, corners), (has_box, boxes)]
    out += messages(4, n, [(0, w, v) for w, v in blocks])
    return bytes(out)


def places(cache: Columns, rows: list[tuple], ms: list[dict], of_m: pa.Array | None, mshape, starts: np.ndarray, counts: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the shapes of the features' rows and, counts of them from starts for rings of the features f, of m-values."""
    known, n = cache.lists[codec.SHAPES], len(rows)
    local: dict[tuple, int] = {}
    mine = np.fromiter((local.setdefault(r, len(local)) for r in rows), np.int64, n)
    codes = np.zeros(0, np.int64)
    if counts.any():
        ms = [*ms, {}]
        codes = pc.fill_null(of_m, len(ms) - 1).to_numpy(zero_copy_only=False)[spans(starts, counts)].astype(np.int64)
        times = np.bincount(codes, minlength=len(ms))
        used = np.flatnonzero(times)
        to = np.zeros(len(ms), np.int64)
        to[used] = [local.setdefault(r, len(local)) for r in cache.rows([ms[i] for i in used.tolist()], mshape, times[used].tolist())]
        codes = to[codes]
    of_feature = np.zeros(n, np.int64)
    np.add.at(of_feature, f, counts)
    at = bounds(1 + of_feature)
    both, rest = np.empty(at[-1], np.int64), np.ones(at[-1], bool)
    rest[at[:-1]] = False
    both[at[:-1]], both[rest] = mine, codes
    coded, keys = pa.array(both).dictionary_encode(), list(local)
    place = np.array([known.setdefault(keys[c], len(known)) for c in coded.dictionary.to_pylist()], np.int64)
    both = place[coded.indices.to_numpy()]
    return both[at[:-1]], both[rest]


def offsets_at(column: pa.ListArray | None, n: int, f: np.ndarray, p: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the features have any offset, and those of the ring r of the polygon p of the features f."""
    none = np.zeros(n, bool), np.zeros(len(f))
    if column is None:
        return none
    lines, n_lines = lists_of(column, n)
    values, n_values = lists_of(lines, len(lines))
    values = np.append(pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(float), 0.0)
    if len(values) == 1:
        return none
    of_feature, of_line = bounds(n_lines), bounds(n_values)
    has = per_piece((values[:-1] > 0).astype(np.int64), of_line[of_feature]) > 0
    line = np.where(p < n_lines[f], of_feature[f] + p, len(lines))
    there = r < np.append(n_values, 0)[line]
    return has, values[np.where(there, of_line[line] + r, len(values) - 1)]


def woven(axes: list[np.ndarray], at: np.ndarray, deep: np.ndarray) -> np.ndarray:
    """The interleaved steps of pieces of vertices; deep: which vertices have three axes."""
    d = [zigzag(steps_in(a, at)) for a in (axes if deep.any() else axes[:2])]
    if any(((v > 65535) & (deep if k == 2 else True)).any() for k, v in enumerate(d)):
        raise ValueError("a step or a point does not fit 16 bits")
    if not deep.any():
        return weave(d)
    if deep.all():
        return weave(d)
    codes = weave(d[:2])
    codes[deep] = weave([v[deep] for v in d])
    return codes


def kept(cache: Columns, column: int, *groups: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Places in a column of the pieces of each group (their features, their numbers, how many of them each has); pieces
    come in by feature, then by group."""
    features, numbers, counts = (np.concatenate(v) for v in zip(*groups))
    data, at = put(numbers), bounds(sizes(numbers))[bounds(counts)]
    order = np.argsort(features, kind="stable")
    starts, width = at[:-1][order], np.diff(at)[order]
    if (np.diff(order) != 1).any():
        data = data[spans(starts, width)]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(bounds(width)), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    place = cache.piece_places(column, coded.dictionary)
    got = np.empty(len(order), np.int64)
    got[order] = place[coded.indices.to_numpy()]
    return np.split(got, np.cumsum([len(f) for f, _, _ in groups])[:-1])


# Reading


def batches(data: bytes, schema: pa.Schema, key: str, value, layers: set[str] | None = None, rows_only: bool = False, only: int | None = None, skip: bool = False) -> Iterator[pa.RecordBatch]:
    """A tile's features as columns of the schema, some thousands at a time."""
    for layer in codec.read_tile(data, set(schema.names), layers, rows_only, only, skip, lazy=True)["layers"]:
        yield from layer_batches(layer, schema, {key: value})


def layer_batches(layer: dict, schema: pa.Schema, fixed: dict) -> Iterator[pa.RecordBatch]:
    """A layer whose features are messages as batches; fixed: values that all rows have."""
    wanted, fixed = set(schema.names), fixed | {c: layer[c] for c in ("layer", "kind", "extent")}
    fixed |= {c: None if layer[c] is None else text_of(layer[c]) for c in ("shape", "mshape") if c in wanted}
    raw = layer["features"]
    for a in range(0, len(raw), SLICE):
        part = raw[a : a + SLICE]
        made = (open_columns if layer["kind"] == "open" else mvt_columns)(layer, part, wanted)
        out = []
        for f in schema:
            if f.name in fixed:
                got = pa.repeat(pa.scalar(fixed[f.name], f.type), len(part))
            else:
                got = made.get(f.name)
                if got is None:
                    got = pa.nulls(len(part), f.type)
                elif callable(got):
                    got = got(f.type)
                elif not isinstance(got, (pa.Array, pa.ChunkedArray)):
                    got = pa.array(got, f.type)
                elif got.type != f.type:
                    got = got.cast(f.type)
            out.append(got)
        yield pa.RecordBatch.from_arrays(out, schema=schema)


def nest(polys: np.ndarray, rings: np.ndarray, points: np.ndarray, axes: list) -> object:
    """Offsets and coordinates (x, y, z or None, texts of m-values or None) as an array of a nested type to be given."""

    def build(kind: pa.DataType) -> pa.Array:
        ring = kind.value_type
        vertex = ring.value_type.value_type
        n = int(points[-1])
        flat = pa.StructArray.from_arrays([pa.nulls(n, f.type) if a is None else a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(axes, vertex)], fields=list(vertex))
        made = pa.ListArray.from_arrays(pa.array(points, pa.int32()), flat, type=ring.value_type)
        made = pa.ListArray.from_arrays(pa.array(rings, pa.int32()), made, type=ring)
        return pa.ListArray.from_arrays(pa.array(polys, pa.int32()), made, type=kind)

    return build


def texts(values: list) -> pa.Array:
    return pa.array(values, pa.string())


def mvt_columns(layer: dict, raw: list, wanted: set[str]) -> dict:
    flat, n = layer["kind"] == "flat", len(raw)
    tag_id, tag_pairs, tag_type, tag_geometry, tag_indices, tag_corners = (15, 1, 2, 3, 4, 5) if flat else (1, 2, 3, 4, 5, 6)
    alike, parts = scan([f for _, f in raw]), []
    if alike is None or any(t in alike[1] and len(alike[1][t]) != (1 if t in (tag_id, tag_type) else 2) for t in (tag_id, tag_pairs, tag_type, tag_geometry, tag_indices, tag_corners)):
        alike, parts = None, [{tag: v for tag, _, v in wire.fields(f)} for _, f in raw]

    def number(tag: int) -> list | np.ndarray | None:
        if alike:
            return alike[1][tag][0] if tag in alike[1] else None
        return [p.get(tag) for p in parts]

    def pieces(tag: int) -> list:
        if not alike:
            return [p.get(tag) for p in parts]
        if tag not in alike[1]:
            return [None] * n
        data, (starts, size) = alike[0].data, alike[1][tag]
        return [data[a:b] for a, b in zip(starts.tolist(), (starts + size).tolist())]

    def numbers(tag: int) -> tuple[np.ndarray, np.ndarray]:
        if alike and tag in alike[1]:
            starts, size = alike[1][tag]
            return packed_in(alike[0][spans(starts, size)], bounds(size))
        return packed_many([p or b"" for p in pieces(tag)])

    kinds = number(tag_type)
    kinds = np.ones(n, np.int64) if kinds is None else np.array([1 if k is None else k for k in kinds] if parts else kinds, np.int64)
    out: dict = {"fid": [i for i, _ in raw], "type": np.where(kinds == 4, 3, kinds)}
    if "id" in wanted:
        ids = number(tag_id)
        out["id"] = None if ids is None else pa.array(ids, pa.uint64())
    if "properties" in wanted:
        if "texts" not in layer:
            layer["texts"] = texts([text_of(bytes(k).decode()) + ":" for k in layer["keys"]]), mvt_values(layer)
            layer["texts"] = *layer["texts"], texts([str(v) if type(v) is int else text_of(v) for v in layer["texts"][1]])
        out["properties"] = mvt_properties(layer, *numbers(tag_pairs))
    if "values" in wanted:
        pairs, pairs_at = numbers(tag_pairs)
        out["values"] = lambda kind: mvt_typed(layer, pairs, pairs_at, kind)
    if "geometry" in wanted:
        there = tag_geometry in alike[1] if alike else all(tag_geometry in p for p in parts)
        out["geometry"] = mvt_geometry(kinds, numbers(tag_geometry) if there else None, lambda: pieces(tag_geometry), flat)
    for name, tag, width in (("indices", tag_indices, 1), ("tessellation", tag_corners, 2)):
        missing = np.full(n, tag not in alike[1]) if alike else np.array([tag not in p for p in parts], bool)
        if name in wanted and not missing.all():
            v, at = numbers(tag)
            if (np.diff(at) % width).any():
                out[name] = [None if p is None else corners(wire.packed(p)) for p in pieces(tag)]
            else:
                out[name] = listed([sums_in(unzigzag(v[k::width]), at // width) for k in range(width)], at // width, missing)
    return out


def listed(axes: list[np.ndarray], at: np.ndarray, missing: np.ndarray, flat: np.ndarray | None = None) -> object:
    """Lists of whole numbers, or of corners of two or three axes; flat: which lists' corners have no third one."""

    def build(kind: pa.DataType) -> pa.Array:
        if len(axes) == 1:
            values = pa.array(axes[0], kind.value_type)
        else:
            third = pa.nulls(len(axes[0]), pa.int64()) if len(axes) < 3 else pa.array(axes[2], mask=np.repeat(flat, np.diff(at)))
            values = pa.StructArray.from_arrays([pa.array(axes[0]), pa.array(axes[1]), third], fields=list(kind.value_type))
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, type=kind, mask=pa.array(missing) if missing.any() else None)

    return build


def corners(n: list[int]) -> list[dict]:
    return [{"x": x, "y": y, "z": None} for x, y in zip(codec.sums(n[::2]), codec.sums(n[1::2]))]


def mvt_values(layer: dict) -> list:
    """A row-oriented layer's values; those that are unsigned numbers are read together."""
    if "plain" not in layer:
        raw = layer["values"]
        first = [v[:1] == b"(" for v in raw]  # field 5, a varint
        found = scan([v for v, h in zip(raw, first) if h])
        if found and list(found[1]) == [5]:
            numbers = iter(found[1][5][0].tolist())
            layer["plain"] = [next(numbers) if h else codec.mvt_value(v) for v, h in zip(raw, first)]
        else:
            layer["plain"] = [codec.mvt_value(v) for v in raw]
    return layer["plain"]


def mvt_typed(layer: dict, v: np.ndarray, at: np.ndarray, kind: pa.StructType) -> pa.Array:
    """Values of the properties named by kind's fields; of a name that comes twice the last."""
    if (np.diff(at) % 2).any():
        raise ValueError("a feature's properties end with a key")
    n, names, values = len(at) - 1, [bytes(k).decode() for k in layer["keys"]], mvt_values(layer)
    keys, which = v[::2].astype(np.int64), v[1::2].astype(np.int64)
    if len(v) and (keys.max() >= len(names) or which.max() >= len(values)):
        raise IndexError("a key or value that the layer doesn't have")
    feature, out = np.repeat(np.arange(n), np.diff(at) // 2), []
    for f in kind:
        place = np.full(n, -1)
        for k in [k for k, name in enumerate(names) if name == f.name]:
            here = keys == k
            place[feature[here]] = which[here]
        used = np.zeros(len(values), bool)
        used[place[place >= 0]] = True
        used = np.flatnonzero(used)
        to = np.zeros(len(values) + 1, np.int64)
        to[used] = np.arange(len(used))
        out.append(typed([values[i] for i in used.tolist()], f.type).take(pa.array(to[place], mask=place < 0)))
    return pa.StructArray.from_arrays(out, fields=list(kind))


def typed(values: list, kind: pa.DataType) -> pa.Array:
    """Values as a column of a type; texts take all scalars, other types only their own."""
    there = set(map(type, values)) - {type(None)}
    if pa.types.is_string(kind):
        return pa.array([v if v is None or type(v) is str else text_of(v) for v in values], kind)
    fits = {bool} if pa.types.is_boolean(kind) else {int} if pa.types.is_integer(kind) else {int, float}
    if not there <= fits:
        raise ValueError(f"a property of another type than {kind}")
    try:
        return pa.array(values, kind)
    except OverflowError as e:
        raise ValueError(f"a property that doesn't fit {kind}") from e


def mvt_properties(layer: dict, v: np.ndarray, at: np.ndarray) -> pa.Array:
    keys, values, value_texts = layer["texts"]
    if (np.diff(at) % 2).any() or repeats(v[::2], at // 2):
        names = [bytes(k).decode() for k in layer["keys"]]
        rows = [v[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        return texts([text_of({names[k]: values[x] for k, x in zip(r[::2], r[1::2])}) for r in rows])
    pairs = pc.binary_join_element_wise(keys.take(pa.array(v[::2])), value_texts.take(pa.array(v[1::2])), "")
    return pc.binary_join_element_wise("{", pc.binary_join(pa.ListArray.from_arrays(pa.array(at // 2, pa.int32()), pairs), ","), "}", "")


def repeats(keys: np.ndarray, at: np.ndarray) -> bool:
    """Whether a piece has a number twice."""
    n = np.diff(at)
    if len(n) and (n == n[0]).all() and n[0] and len(keys):
        rows = keys.reshape(-1, n[0])
        if (rows == rows[0]).all():
            return len(set(rows[0].tolist())) < n[0]
    code = np.repeat(np.arange(len(n)).astype(U64), n) * (keys.max() + U64(1) if len(keys) else U64(1)) + keys
    return len(np.unique(code)) < len(code)


def mvt_geometry(kinds: np.ndarray, numbers: tuple | None, pieces, flat: bool) -> object:
    if numbers and (kinds < 3).all() and (kinds > 0).all():
        t, at = numbers
        n, s = np.diff(at), at[:-1]
        # One vertex, or a line of one stretch: move to, two numbers, line to, two numbers for each further vertex.
        if (n >= 3).all() and (t[s] == 9).all():
            more = n > 3
            if not (more & (kinds == 1)).any() and (n[more] > 4).all() and (t[s[more] + 3] == ((n[more] - 4) // 2 << 3 | 2)).all() and (n[more] % 2 == 0).all():
                keep = np.ones(len(t), bool)
                keep[s] = False
                keep[s[more] + 3] = False
                d = unzigzag(t[keep]).reshape(-1, 2)
                points = bounds(np.where(more, n // 2 - 1, 1))
                each = np.arange(len(n) + 1)
                return nest(each, each, points, [sums_in(d[:, 0], points), sums_in(d[:, 1], points), None, None])
    found = stretches(kinds, *numbers, flat) if numbers else None
    if found is not None:
        return found
    made = [None if p is None else codec.commands(wire.packed(p), k, flat) for p, k in zip(pieces(), kinds.tolist())]
    return lambda kind: nested(made, kind)


def stretches(kinds: np.ndarray, t: np.ndarray, at: np.ndarray, flat: bool) -> object | None:
    """Geometries of lone points, lines and polygons whose rings are each one stretch (move to, line to, and of polygons a
    closing; in flat ones an end after each polygon); None where a stream has another form. All features go ahead a ring a step."""
    n, poly = np.diff(at), kinds > 2
    if (kinds < 1).any() or (kinds > 4).any() or ((kinds == 1) & (n != 3)).any() or not len(t) or n.max() > 1000 + 16 * n.mean():
        return None
    pos, ends, act = at[:-1].copy(), at[1:], np.flatnonzero(n)
    t = np.append(t, np.zeros(8, U64))
    steps: list[tuple] = []
    while len(act):
        p, e, closed = pos[act], ends[act], poly[act]
        more = (p + 3 < e) & ((t[p + 3] & U64(7)) == 2)
        k = np.where(more, t[p + 3] >> U64(3), 0).astype(np.int64)
        end = p + 3 + np.where(more, 1 + 2 * k, 0)
        if ((t[p] != 9) | (end > e) | (more & (k < 1)) | (closed & ~more)).any() or (closed & ((end >= e) | (t[np.minimum(end, e)] != 15))).any():
            return None
        end += closed
        stop = (closed & (end < e) & (t[end] == 12)) if flat else np.zeros(len(act), bool)
        pos[act] = end + stop
        steps.append((act, p, k, stop))
        act = act[pos[act] < e]
    f, p, k, stop = (np.concatenate(v) for v in zip(*steps))
    order = np.argsort(f, kind="stable")
    f, p, count, stop = f[order], p[order], k[order] + 1, stop[order]
    rings = bounds(np.bincount(f, minlength=len(n)))
    starts = bounds(count)
    j = np.arange(starts[-1]) - np.repeat(starts[:-1], count)
    place = np.repeat(p + 1, count) + 2 * j + (j > 0)
    closed, size = poly[f], count + poly[f]
    points = bounds(size)
    take = spans(starts[:-1], size)
    take[points[1:][closed] - 1] = starts[:-1][closed]
    x, y = (sums_in(unzigzag(t[place + i]), starts[rings])[take] for i in (0, 1))
    begins, keep = np.diff(f, prepend=-1) > 0, None
    if flat:
        last = np.append(begins[1:], True)
        if (closed & last & ~stop).any():
            return None
        begins[1:] |= stop[:-1]
    elif poly.any():
        if max(np.abs(x).max(), np.abs(y).max()) >= 1 << 20:
            return None
        before = np.arange(len(x)) - 1
        before[points[:-1]] = points[1:] - 1
        area = per_piece((x[before] - x) * (y[before] + y), points)
        sized = area != 0
        split = poly & (np.diff(rings) > 1) & (per_piece(sized.astype(np.int64), rings) > 0)
        first, there = np.zeros(len(n), np.int64), np.flatnonzero(sized)
        first[split] = there[np.searchsorted(there, rings[:-1][split])]
        begins = np.where(split[f], sized & ((area < 0) == (area < 0)[first[f]]), begins)
        keep = ~split[f] | sized
        if keep.all():
            keep = None
    if keep is not None:
        stay = np.repeat(keep, size)
        x, y, f, size, begins = x[stay], y[stay], f[keep], size[keep], begins[keep]
    return nest(bounds(np.bincount(f[begins], minlength=len(n))), np.append(np.flatnonzero(begins), len(f)), bounds(size), [x, y, None, None])


def nested(geometries: list, kind: pa.DataType) -> pa.Array:
    """Geometries (polygon, ring, vertex (x, y); None where there is none) as one array of the nested type."""
    polys, rings, points = [0], [0], [0]
    x, y = [], []
    for g in geometries:
        for poly in g or ():
            for ring in poly:
                x.extend([v[0] for v in ring])
                y.extend([v[1] for v in ring])
                points.append(len(x))
            rings.append(len(points) - 1)
        polys.append(len(rings) - 1)
    got = nest(np.array(polys), np.array(rings), np.array(points), [x, y, None, None])(kind)
    return pa.ListArray.from_arrays(got.offsets, got.values, type=kind, mask=pa.array([g is None for g in geometries], pa.bool_())) if any(g is None for g in geometries) else got


class Seen:
    """What of a tile's cache was decoded for all its features at once."""

    def __init__(self, cache: codec.Cache) -> None:
        self.cache, self.columns, self.rings = cache, {}, {}

    def texts(self, column: int, truth: bool = False) -> pa.Array:
        if (column, truth) not in self.columns:
            raw = self.cache.raw[column]
            if column == codec.U64:
                v = pa.array(numbers_of(raw))
                got = pc.if_else(pc.not_equal(v, pa.scalar(0, pa.uint64())), "true", "false") if truth else v.cast(pa.string())
            elif column == codec.I64:
                got = pa.array(unzigzag(numbers_of(raw))).cast(pa.string())
            elif column == codec.STRING:
                got = texts([text_of(bytes(v).decode()) for _, v in raw])
            else:
                got = texts([text_of(wire.number(k, v)) for k, v in raw])
            self.columns[column, truth] = got
        return self.columns[column, truth]

    def objects(self, index: np.ndarray, shape) -> pa.Array:
        """JSON texts of the rows with these places."""
        named = [(k, t) for k, t in shape.items()] if codec.is_flat(shape) else None
        if not named:
            return texts([text_of(self.cache.value(i, shape)) for i in index.tolist()])
        v, at = packed_at(self.cache.raw[codec.SHAPES], index)
        width = sum(t != "null" for _, t in named)
        if (np.diff(at) < width).any():
            raise ValueError("a row of values ends too early")
        parts, k = [], 0
        for i, (name, t) in enumerate(named):
            head = ("," if i else "{") + text_of(name) + ":"
            if t == "null":
                parts.append(pa.scalar(head + "null"))
            else:
                parts += [pa.scalar(head), self.texts(codec.COLUMN_OF[t], t == "bool").take(pa.array(v[at[:-1] + k]))]
                k += 1
        if not width:
            return texts(["".join(p.as_py() for p in parts) + "}"] * len(index))
        return pc.binary_join_element_wise(*parts, "}", "")

    def typed(self, index: np.ndarray, shape, kind: pa.StructType) -> pa.Array:
        """Of the rows with these places the values of the names that kind's fields have."""
        if not codec.is_flat(shape) or not shape:
            rows = [self.cache.value(i, shape) for i in index.tolist()]
            return pa.StructArray.from_arrays([typed([r.get(f.name) for r in rows], f.type) for f in kind], fields=list(kind))
        raw, at_of = self.cache.raw, {name: i for i, name in enumerate(k for k, t in shape.items() if t != "null")}
        v, at = packed_at(raw[codec.SHAPES], index)
        if (np.diff(at) < len(at_of)).any():
            raise ValueError("a row of values ends too early")
        out = []
        for f in kind:
            t = shape.get(f.name, "null")
            if t == "null":
                out.append(pa.nulls(len(index), f.type))
            elif pa.types.is_string(f.type):
                got = self.texts(codec.COLUMN_OF[t], t == "bool") if t != "string" else self.column(t)
                out.append(got.take(pa.array(v[at[:-1] + at_of[f.name]])))
            elif (t == "string") or (t == "bool") != pa.types.is_boolean(f.type) or (t in ("f32", "f64") and not pa.types.is_floating(f.type)):
                raise ValueError(f"a property of another type than {f.type}")
            else:
                out.append(self.column(t).take(pa.array(v[at[:-1] + at_of[f.name]])).cast(f.type))
        return pa.StructArray.from_arrays(out, fields=list(kind))

    def column(self, t: str) -> pa.Array:
        """A column's values by a scalar's type."""
        if t not in self.columns:
            raw = self.cache.raw[codec.COLUMN_OF[t]]
            if t == "string":
                got = texts([bytes(v).decode() for _, v in raw])
            elif t in ("f32", "f64"):
                got = pa.array([wire.number(k, v) for k, v in raw], pa.float64())
            elif t == "i64":
                got = pa.array(unzigzag(numbers_of(raw)))
            else:
                got = pa.array(numbers_of(raw))
                got = pc.not_equal(got, pa.scalar(0, pa.uint64())) if t == "bool" else got
            self.columns[t] = got
        return self.columns[t]

    def boxes(self, index: np.ndarray, there: np.ndarray) -> object:
        raw = self.cache.raw[codec.BBOXES]
        if "boxes" not in self.columns:
            self.columns["boxes"] = box_axes(raw)
        at = pa.array(index.astype(np.int64), mask=~there)
        return lambda kind: pa.StructArray.from_arrays([v.take(at) for v in self.columns["boxes"]], fields=list(kind), mask=pa.array(~there))

    def points(self, three: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Offsets of all rings of the cache and their coordinates."""
        if three not in self.rings:
            v, at = packed_at(self.cache.raw[codec.POINTS3D if three else codec.POINTS])
            self.rings[three] = at, [sums_in(a, at) for a in unweave(v, 3 if three else 2)]
        return self.rings[three]


def box_axes(raw) -> list[pa.Array]:
    """A cache's boxes as columns, near and far null where a box has neither."""
    if isinstance(raw, runs.Entries) and raw.kind == wire.BYTES and len(raw):
        starts, size = raw.spans()
        deep = size == 20
        if (deep | (size == 12)).all():
            b = np.frombuffer(raw.buffer, np.uint8)
            q = b[starts[:, None] + np.arange(12)].astype(np.int64)
            axes = (q[:, ::3] << 16 | q[:, 1::3] << 8 | q[:, 2::3]) * 2 * SPANS / codec.MAX24 - SPANS
            ends = np.zeros((len(raw), 2))
            ends[deep] = b[starts[deep, None] + np.arange(12, 20)].view("<f4")
            return [pa.array(np.ascontiguousarray(v)) for v in axes.T] + [pa.array(np.ascontiguousarray(v), mask=~deep) for v in ends.T]
    return [pa.array(v, pa.float64()) for v in zip(*[(*codec.box_values(bytes(v)), None, None)[:6] for _, v in raw])]


def open_columns(layer: dict, raw: list, wanted: set[str]) -> dict:
    cache: codec.Cache = layer["cache"]
    seen = cache.__dict__.setdefault("seen", Seen(cache))
    t, at = packed_many([f for _, f in raw])
    n, p = len(raw), at[:-1]
    t = np.concatenate((t, np.zeros(8, U64)))
    kind, flags = t[p].astype(np.int64), t[p + 1].astype(np.int64)
    if (np.diff(at) < 2).any() or kind.min() < 1 or kind.max() > 6:
        raise ValueError("unknown feature type" if kind.min() < 1 or kind.max() > 6 else "a feature ends too early")
    has = [(flags >> i & 1).astype(bool) for i in range(7)]
    three, form = kind > 3, (kind - 1) % 3 + 1
    ids, p = t[p + 2], p + 2 + has[0]
    props, where, p = t[p], t[p + 1], p + 2
    index, p = t[p], p + (has[3] & (form == 3))
    corner, p = t[p], p + (has[4] & (form == 3))
    box, p = t[p], p + has[1]
    if (p > at[1:]).any():
        raise ValueError("a feature ends too early")
    out: dict = {"fid": [i for i, _ in raw], "type": kind}
    if "id" in wanted:
        out["id"] = pa.array(ids, pa.uint64(), mask=~has[0])
    if "properties" in wanted:
        out["properties"] = seen.objects(props, layer["shape"])
    if "values" in wanted:
        out["values"] = lambda kind: seen.typed(props, layer["shape"], kind)
    if "geometry" in wanted or "offsets" in wanted:
        out |= open_geometry(layer, seen, kind, where, has)
    here = has[3] & (form == 3)
    if "indices" in wanted and here.any():
        v, a = packed_at(cache.raw[codec.INDICES], index[here])
        count = np.zeros(n, np.int64)
        count[here] = np.diff(a)
        out["indices"] = listed([sums_in(unzigzag(v), a)], bounds(count), ~here)
    here = has[4] & (form == 3)
    if "tessellation" in wanted and here.any():
        count, axes = np.zeros(n, np.int64), []
        for d in (False, True):
            rows = here & (three == d)
            a, _ = seen.points(d)
            count[rows] = np.diff(a)[corner[rows].astype(np.int64)]
        axes = [np.zeros(count.sum(), np.int64) for _ in range(3)]
        for d in (False, True):
            rows = here & (three == d)
            a, values = seen.points(d)
            to, of = spans(bounds(count)[:-1][rows], count[rows]), spans(a[corner[rows].astype(np.int64)], count[rows])
            for k, v in enumerate(values):
                axes[k][to] = v[of]
        out["tessellation"] = listed(axes, bounds(count), ~here, ~three)
    if "bbox" in wanted and has[1].any():
        out["bbox"] = seen.boxes(box, has[1])
    return out


def open_geometry(layer: dict, seen: Seen, kind: np.ndarray, where: np.ndarray, has: list[np.ndarray]) -> dict:
    n, three, form = len(kind), kind > 3, (kind - 1) % 3 + 1
    lone = has[6] & (form == 1)
    each = np.arange(n + 1)
    if lone.all() and not three.any():
        return {"geometry": nest(each, each, each, [*unweave(where, 2), None, None]), "offsets": None}
    k = np.flatnonzero(~lone)
    rest, rest_at = packed_at(seen.cache.raw[codec.INDICES], where[k])
    rest, ends = sums_in(unzigzag(rest), rest_at), {d: seen.points(d)[0] for d in (False, True)}
    f, count, g, rings, shift, m_at = ring_lists(rest, rest_at, form[k], has[6][k], three[k], has[2][k], has[5][k], ends)
    order_p = np.argsort(np.concatenate((k[f], np.flatnonzero(lone))), kind="stable")
    n_rings = np.concatenate((count, np.ones(lone.sum(), np.int64)))[order_p]
    n_polys = np.bincount(k[f], minlength=n) + lone
    of_ring = np.concatenate((k[g], np.flatnonzero(lone)))
    order = np.argsort(of_ring, kind="stable")
    of_ring = of_ring[order]
    deep = three[of_ring]
    rings, shift, m_at = (np.concatenate((v, np.full(lone.sum(), e)))[order] for v, e in ((rings, -1), (shift, 0.0), (m_at, -1)))
    with_m = m_at >= 0
    alone = rings < 0
    count = np.ones(len(rings), np.int64)
    for d in (False, True):
        here = ~alone & (deep == d)
        a = seen.points(d)[0]
        count[here] = np.diff(a)[rings[here]]
    points = bounds(count)
    m_of = rest[spans(m_at[with_m], count[with_m])] if with_m.any() else ()
    axes = [np.zeros(points[-1], np.int64) for _ in range(3)]
    for d in (False, True):
        here = ~alone & (deep == d)
        a, values = seen.points(d)
        to, of = spans(points[:-1][here], count[here]), spans(a[rings[here]], count[here])
        for k, v in enumerate(values):
            axes[k][to] = v[of]
        for k, v in enumerate(unweave(where[lone & (three == d)], 3 if d else 2)):
            axes[k][points[:-1][alone & (deep == d)]] = v
    m = None
    if len(m_of):
        got = seen.objects(m_of, layer["mshape"] or {})
        places = np.full(points[-1], -1, np.int64)
        places[spans(points[:-1][with_m], count[with_m])] = np.arange(len(m_of))
        m = got.take(pa.array(places, mask=places < 0))
    z = pa.array(axes[2], pa.int64(), mask=~np.repeat(deep, count)) if deep.any() else None
    polys, parts = bounds(n_polys), bounds(n_rings)

    def offsets(kind: pa.DataType) -> pa.Array:
        lines = pa.ListArray.from_arrays(pa.array(parts, pa.int32()), pa.array(shift), type=kind.value_type)
        return pa.ListArray.from_arrays(pa.array(polys, pa.int32()), lines, type=kind, mask=pa.array(form == 1))

    return {"geometry": nest(polys, parts, points, [*axes[:2], z, m]), "offsets": offsets}


def ring_lists(v: np.ndarray, at: np.ndarray, form: np.ndarray, single: np.ndarray, deep: np.ndarray, off: np.ndarray, m: np.ndarray, ends: dict) -> tuple[np.ndarray, ...]:
    """What the features' lists of indices say: of each polygon its feature and how many rings it has; of each ring its
    feature, its place in the cache, its offset and where in v its m-values begin (-1: it has none). All features go ahead a
    ring a step, unless one of them is far longer than the others: then each goes by itself."""
    size = np.diff(at)
    if len(size) > 1 and size.max() > 1000 + 16 * size.mean():
        made = [ring_lists(v, at[i : i + 2], form[i : i + 1], single[i : i + 1], deep[i : i + 1], off[i : i + 1], m[i : i + 1], ends) for i in range(len(size))]
        return tuple(np.concatenate([x + i if j in (0, 2) else x for i, x in enumerate(c)]) for j, c in enumerate(zip(*made)))
    pos, last, v = at[:-1].copy(), at[1:], np.append(v, 0)
    polys, rings = np.ones(len(form), np.int64), np.zeros(len(form), np.int64)
    size_of = {d: np.diff(a) for d, a in ends.items()}

    def read(a: np.ndarray) -> np.ndarray:
        if (pos[a] >= last[a]).any():
            raise IndexError("a list of indices ends too early")
        got = v[pos[a]]
        pos[a] += 1
        return got

    a = np.flatnonzero((form == 3) & ~single)
    polys[a] = read(a)
    of_polys, of_rings, act = [(np.zeros(0, np.int64),) * 2], [(np.zeros(0, np.int64),) * 4], np.flatnonzero(polys > 0)
    while len(act):
        a = act[rings[act] <= 0]
        polys[a] -= 1
        rings[a] = 1
        told = a[(form[a] == 3) | ((form[a] == 2) & ~single[a])]
        rings[told] = np.maximum(read(told), 0)
        of_polys.append((a, rings[a]))
        a = act[rings[act] > 0]
        shift = np.zeros(len(a))
        has = off[a] & (form[a] > 1)
        shift[has] = read(a[has]) / 1000
        r = read(a)
        if any(((r[deep[a] == d] < 0) | (r[deep[a] == d] >= len(size_of[d]))).any() for d in size_of):
            raise IndexError("a ring that isn't in the cache")
        of_rings.append((a, r, shift, np.where(m[a], pos[a], -1)))
        for d, sizes_of in size_of.items():
            b = m[a] & (deep[a] == d)
            pos[a[b]] += sizes_of[r[b]]
        if (pos[a] > last[a]).any():
            raise IndexError("a list of indices ends too early")
        rings[a] -= 1
        act = act[(rings[act] > 0) | (polys[act] > 0)]
    out = []
    for found in (of_polys, of_rings):
        made = [np.concatenate(c) for c in zip(*found)]
        order = np.argsort(made[0], kind="stable")
        out += [c[order] for c in made]
    return tuple(out)
