"""Tiles as bytes: reading and writing the row-oriented formats (MVT and its flat extension) and the columnar one.

Works on plain Python values, one tile at a time; the DataFrame side is in ``tiles`` and ``operators.encode``. Choices
where implementations of these formats differ: latitude and coordinates are rounded half up, offsets rounded down and
written for every line of a feature that has one, steps that don't fit 16 bits are an error, unknown tags are skipped by
their wire type, layers and caches come in any order, and all geometries keep three levels.
"""

from __future__ import annotations

import decimal
import json
import math
import struct
from itertools import pairwise

from . import runs, wire
from .wire import fields, packed, put, put_bytes, put_double, put_float, put_packed, put_text, unzigzag, zigzag

#: Fixed tags of a tile's parts and column types of the cache.
FLAT, MVT, OPEN, CACHE, GRID, IMAGE = 1, 3, 4, 5, 6, 7
STRING, U64, I64, F32, F64, POINTS, POINTS3D, INDICES, SHAPES, BBOXES = range(1, 11)
EXTENTS = (512, 1024, 2048, 4096, 8192, 16384)
TYPES = ("string", "u64", "i64", "f32", "f64", "bool", "null")
IMAGE_TYPES = ("png", "jpg", "webp", "gif", "avif", "svg", "bmp", "raw", "unknown")
MAX24 = 16_777_215


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


# Numbers interleaved bit by bit


def spread(v: int, every: int) -> int:
    return sum(((v >> i) & 1) << (every * i) for i in range(16))


def squeeze(v: int, every: int) -> int:
    return sum(((v >> (every * i)) & 1) << i for i in range(16))


SPREAD2, SPREAD3 = ([spread(v, n) for v in range(256)] for n in (2, 3))


def weave(values: list[int], table: list[int]) -> int:
    n = len(values)
    return sum((table[v & 255] | table[v >> 8] << (8 * n)) << k for k, v in enumerate(values))


def steps(points: list[tuple[int, ...]]) -> list[int]:
    """Points as interleaved zigzagged steps, each of which must fit 16 bits."""
    if not points:
        return []
    table = SPREAD2 if len(points[0]) == 2 else SPREAD3
    out = []
    for a, b in pairwise([(0,) * len(points[0]), *points]):
        d = [zigzag(q - p) for p, q in zip(a, b)]
        if max(d) > 65535:
            raise ValueError(f"a step from {a} to {b} does not fit 16 bits")
        out.append(weave(d, table))
    return out


def walk(values: list[int], axes: int) -> list[tuple[int, ...]]:
    at, out = [0] * axes, []
    for v in values:
        at = [p + unzigzag(squeeze(v >> k, axes)) for k, p in enumerate(at)]
        out.append(tuple(at))
    return out


def deltas(values: list[int]) -> list[int]:
    return [zigzag(b - a) for a, b in pairwise([0, *values])]


def sums(values: list[int]) -> list[int]:
    out, at = [], 0
    for v in values:
        at += unzigzag(v)
        out.append(at)
    return out


def box_bytes(b: list[float]) -> bytes:
    """left, bottom, right, top in 24 bits each, and near and far as floats if there are six."""
    q = [half_up((v + h) * MAX24 / (2 * h)) & MAX24 for v, h in zip(b[:4], (180, 90, 180, 90))]
    return b"".join(v.to_bytes(3, "big") for v in q) + b"".join(struct.pack("<f", v) for v in b[4:6])


def box_values(data: bytes) -> list[float]:
    q = [int.from_bytes(data[i : i + 3], "big") for i in range(0, 12, 3)]
    return [v * 2 * h / MAX24 - h for v, h in zip(q, (180.0, 90.0, 180.0, 90.0))] + ([*struct.unpack("<ff", data[12:20])] if len(data) == 20 else [])


# Rings


def area2(ring: list[tuple[int, ...]]) -> int:
    return sum((a[0] - b[0]) * (a[1] + b[1]) for a, b in zip([ring[-1], *ring[:-1]], ring)) if ring else 0


def group_rings(rings: list) -> list[list]:
    """Polygons of rings: the winding of the first ring with an area is the outer one; rings without area go, unless all lack it."""
    sized = [(r, a) for r in rings if (a := area2(r)) != 0]
    if len(rings) <= 1 or not sized:
        return [rings] if rings else []
    out: list[list] = []
    for ring, a in sized:
        if (a < 0) == (sized[0][1] < 0):
            out.append([ring])
        else:
            out[-1].append(ring)
    return out


# Row-oriented layers


def mvt_value(data: memoryview):
    for tag, kind, v in fields(data):
        if tag == 1:
            return bytes(v).decode()
        if tag in (2, 3):
            return wire.number(kind, v)
        if tag == 4:
            return v - (1 << 64) if v >= 1 << 63 else v
        if tag == 5:
            return v
        if tag == 6:
            return unzigzag(v)
        if tag == 7:
            return bool(v)
    return None


def commands(numbers: list[int], kind: int, flat: bool) -> list[list[list[tuple[int, int]]]]:
    """The geometry of a command stream, always polygon, ring, point; kind is 1 points, 2 lines, 3 or 4 polygons."""
    rings: list[list] = []
    polys: list[list] = []
    line: list[tuple[int, int]] = []
    x = y = i = 0
    while i < len(numbers):
        what, count = numbers[i] & 7, numbers[i] >> 3
        i += 1
        if what in (1, 2):
            for _ in range(count):
                x, y = x + unzigzag(numbers[i]), y + unzigzag(numbers[i + 1])
                i += 2
                if what == 1 and kind != 1 and line:
                    rings.append(line)
                    line = []
                line.append((x, y))
        elif what == 7:
            if line:  # a second one in a row closes nothing
                rings.append([*line, line[0]])
                line = []
        elif what == 4:
            if line:
                rings.append(line)
                line = []
            if rings:
                polys.append(rings)
                rings = []
        else:
            raise ValueError(f"unknown geometry command {what}")
    if line:
        rings.append(line)
    if kind in (1, 2):
        return [rings] if rings else []
    if polys and not flat:
        rings = [r for p in polys for r in p] + rings
        polys = []
    return polys + group_rings(rings)


def read_mvt_layer(data: memoryview, flat: bool, wanted: set[str] | None = None, layers: set[str] | None = None, only: int | None = None, skip: bool = False, lazy: bool = False) -> dict:
    """A layer with its features; what isn't among the wanted columns stays undecoded, as do features of layers that aren't
    asked for, and all but one where ``only`` is its index. lazy: features are (index, message), keys and values are raw."""
    layer = {"kind": "flat" if flat else "mvt", "version": 1, "layer": "", "extent": 4096, "shape": None, "mshape": None}
    parts, lists = parts_of(data, (2, 3, 4))
    layer |= {c: parts[t] for t, c in ((15, "version"), (5, "extent")) if t in parts}
    if 1 in parts:
        layer["layer"] = bytes(parts[1]).decode()
    raw = lists[2]
    layer["n_features"], layer["features"] = len(raw), []
    if layers is not None and layer["layer"] not in layers:
        return layer
    keys, values = views(lists[3]), views(lists[4])
    if lazy:
        return layer | {"features": chosen(raw, only, skip), "keys": keys, "values": values}
    want = lambda name: wanted is None or name in wanted
    if want("properties"):
        keys, values = [bytes(k).decode() for k in keys], [mvt_value(v) for v in values]
    #: Tags of id, properties, type, geometry, indices, tessellation.
    at = (15, 1, 2, 3, 4, 5) if flat else (1, 2, 3, 4, 5, 6)
    for fid, f in chosen(raw, only, skip):
        parts = {tag: v for tag, _, v in fields(f)}
        kind = parts.get(at[2], 1)
        out = {"fid": fid, "id": parts.get(at[0]), "type": 3 if kind == 4 else kind, "properties": None, "geometry": None, "offsets": None, "bbox": None, "indices": None, "tessellation": None}
        if want("properties"):
            pairs = packed(parts.get(at[1], b""))
            out["properties"] = {keys[k]: values[v] for k, v in zip(pairs[::2], pairs[1::2])}
        if want("geometry") and at[3] in parts:
            out["geometry"] = [[[(x, y, None, None) for x, y in r] for r in p] for p in commands(packed(parts[at[3]]), kind, flat)]
        if want("indices") and at[4] in parts:
            out["indices"] = sums(packed(parts[at[4]]))
        if want("tessellation") and at[5] in parts:
            n = packed(parts[at[5]])
            out["tessellation"] = [(x, y, None) for x, y in zip(sums(n[::2]), sums(n[1::2]))]
        layer["features"].append(out)
    return layer


def parts_of(data: memoryview, many: tuple[int, ...]) -> tuple[dict[int, object], dict[int, list]]:
    """A message's fields: the last of each tag, and of the tags in many all of them."""
    found, last, lists = runs.read(data), {}, {t: [] for t in many}
    if found is not None:
        for tag, v in found.items():
            if tag in lists:
                lists[tag] = v if v.kind == wire.BYTES else list(map(_second, v))
            else:
                last[tag] = v[len(v) - 1][1]
        return last, lists
    for tag, _, v in fields(data):
        if tag in lists:
            lists[tag].append(v)
        else:
            last[tag] = v
    return last, lists


def _second(pair: tuple):
    return pair[1]


def views(raw) -> list:
    return list(map(_second, raw)) if isinstance(raw, runs.Entries) else raw


def chosen(raw: list, only: int | None, skip: bool) -> list[tuple[int, object]]:
    """(index, message) of all features, or of the one asked for; an index that no feature has is an error, or skipped."""
    if only is None:
        return list(enumerate(views(raw)))
    if not 0 <= only < len(raw):
        if skip:
            return []
        raise ValueError("feature index out of bounds")
    return [(only, raw[only][1] if isinstance(raw, runs.Entries) else raw[only])]


def write_mvt_value(value) -> bytes:
    out = bytearray()
    if isinstance(value, bool):
        put(out, 7, int(value))
    elif isinstance(value, str):
        put_text(out, 1, value)
    elif isinstance(value, int):
        put(out, 5, value) if value >= 0 else put(out, 6, zigzag(value))
    elif float(value).is_integer() and abs(value) < 2**53:
        return write_mvt_value(int(value))
    else:
        put_double(out, 3, value)
    return bytes(out)


def geometry_commands(feature: dict, plain: bool) -> list[int]:
    out, x, y = [], 0, 0

    def go(points) -> None:
        nonlocal x, y
        for p in points:
            out.extend((zigzag(p[0] - x), zigzag(p[1] - y)))
            x, y = p[0], p[1]

    kind = (feature["type"] - 1) % 3 + 1
    for poly in feature["geometry"] or []:
        for ring in poly:
            if kind == 1:
                for p in ring:
                    out.append(1 << 3 | 1)
                    go([p])
                continue
            body = ring[:-1] if kind == 3 and len(ring) > 1 else ring
            if not body:
                continue
            out.append(1 << 3 | 1)
            go(body[:1])
            if len(body) > 1:
                out.append((len(body) - 1) << 3 | 2)
                go(body[1:])
            if kind == 3:
                out.append(1 << 3 | 7)
        if kind == 3 and not plain:
            out.append(1 << 3 | 4)
    return out


def write_mvt_layer(layer: dict, plain: bool) -> bytes:
    """A layer of 2D features; values that are no scalars become JSON texts. plain: MVT, else its flat extension."""
    out = bytearray()
    put(out, 15, 1 if plain else 5)
    put_text(out, 1, layer["layer"] or "")
    put(out, 5, layer["extent"] or 4096)
    keys: dict[str, int] = {}
    values: dict[tuple, int] = {}
    at = (1, 2, 3, 4, 5, 6) if plain else (15, 1, 2, 3, 4, 5)
    for f in layer["features"]:
        body, pairs = bytearray(), []
        if f.get("id") is not None:
            put(body, at[0], int(f["id"]))
        for k, v in (f.get("properties") or {}).items():
            if not isinstance(v, (str, bool, int, float)):
                v = json.dumps(v, separators=(",", ":"), ensure_ascii=False)
            pairs += [keys.setdefault(k, len(keys)), values.setdefault((type(v) is bool, type(v) is str, v), len(values))]
        put_packed(body, at[1], pairs)
        kind = (f["type"] - 1) % 3 + 1
        put(body, at[2], kind if plain or kind < 3 else 4)
        put_packed(body, at[3], geometry_commands(f, plain))
        if f.get("indices"):
            put_packed(body, at[4], deltas(f["indices"]))
        if f.get("tessellation"):
            x, y = deltas([p[0] for p in f["tessellation"]]), deltas([p[1] for p in f["tessellation"]])
            put_packed(body, at[5], [v for pair in zip(x, y) for v in pair])
        put_bytes(out, 2, body)
    for k in keys:
        put_text(out, 3, k)
    for _, _, v in values:
        put_bytes(out, 4, write_mvt_value(v))
    return bytes(out)


# Shapes: the schema of a layer's properties


def type_of(value):
    """A value's shape: a type name, [element shape], or {key: shape}."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float, decimal.Decimal)):
        return ("i64" if value < 0 else "u64") if value == value and abs(value) != math.inf and value == int(value) else "f64"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return {k: type_of(v) for k, v in value.items()}
    shape = None
    for v in value:
        other = type_of(v)
        if isinstance(other, list):
            raise ValueError("an array can't hold arrays")
        if isinstance(other, dict) and any(isinstance(x, (list, dict)) for x in other.values()):
            raise ValueError("an object in an array holds scalars only")
        shape = other if shape is None else widen(shape, other, strict=True)
    return [shape if shape is not None else "null"]


NUMBERS = ("u64", "i64", "f32", "f64")


def widen(a, b, strict: bool = False):
    """The least shape for values of both; strict: mixed types are an error, else text takes all and null gives way."""
    if a == b:
        return a
    if a in NUMBERS and b in NUMBERS:
        return max(a, b, key=NUMBERS.index)
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: widen(a[k], b[k], strict) if k in a and k in b else a.get(k, b.get(k)) for k in [*a, *(k for k in b if k not in a)]}
    if not strict:
        if a == "null":
            return b
        if b == "null":
            return a
        if isinstance(a, list) and isinstance(b, list):
            return [widen(a[0], b[0])]
        if isinstance(a, str) and isinstance(b, str):
            return "string"
    raise ValueError(f"types differ: {a} and {b}")


def infer(values, last_wins: bool = False) -> dict:
    """The shape of many property objects."""
    out: dict = {}
    for v in values:
        for k, x in (v or {}).items():
            t = "string" if type(x) is str else type_of(x)
            if last_wins or k not in out:
                out[k] = t
            elif out[k] != t:
                out[k] = widen(out[k], t)
    return out


def check_shape(shape, inside: bool = False) -> None:
    """Raises unless shape is well formed: names of types, arrays of a type or of an object of types, objects."""
    if isinstance(shape, str):
        if shape not in TYPES:
            raise ValueError(f"unknown type {shape}")
    elif isinstance(shape, list):
        if len(shape) != 1:
            raise ValueError("an array shape has one element")
        if isinstance(shape[0], list) or (isinstance(shape[0], dict) and any(not isinstance(v, str) for v in shape[0].values())):
            raise ValueError("an array holds scalars or objects of scalars")
        check_shape(shape[0], True)
    elif isinstance(shape, dict):
        for v in shape.values():
            check_shape(v, inside)
    else:
        raise ValueError(f"no shape: {shape!r}")


# The columnar format


#: The column of a scalar's type; truth values are numbers 0 and 1.
COLUMN_OF = {"string": STRING, "u64": U64, "i64": I64, "f32": F32, "f64": F64, "bool": U64}


def is_flat(shape) -> bool:
    """Whether a shape is an object of scalars."""
    return isinstance(shape, dict) and all(isinstance(t, str) for t in shape.values())


class Columns:
    """The cache of a tile that is written: each value once per column. Numbers are referred to by value until the end, as
    their columns are ordered by how often a value is used."""

    def __init__(self) -> None:
        self.lists: dict[int, dict] = {c: {} for c in (STRING, POINTS, POINTS3D, INDICES, SHAPES, BBOXES)}
        self.numbers: dict[int, dict] = {c: {} for c in (U64, I64, F32, F64)}

    def add(self, column: int, key) -> int:
        return self.lists[column].setdefault(key, len(self.lists[column]))

    def refer(self, column: int, value) -> tuple[int, object]:
        if column in (U64, I64):
            value = int(value)
        else:
            value = struct.unpack("<f", struct.pack("<f", value))[0] if column == F32 else float(value)
        count = self.numbers[column]
        count[value] = count.get(value, 0) + 1
        return column, value

    def shape(self, shape) -> int:
        out: list[int] = []

        def walk_shape(s) -> None:
            if isinstance(s, list):
                out.append(0)
                walk_shape(s[0])
            elif isinstance(s, dict):
                out.append(len(s) << 2 | 1)
                for k, v in s.items():
                    out.append(self.add(STRING, k))
                    walk_shape(v)
            else:
                out.append((TYPES.index(s) + 1) << 2 | 2)

        walk_shape(shape)
        return self.add(SHAPES, tuple(out))

    def value(self, value, shape) -> int:
        return self.add(SHAPES, self.row(value, shape))

    def row(self, value, shape) -> tuple:
        """A value's scalars as references to their columns; they are counted, the row isn't kept yet."""
        if is_flat(shape):
            out: list = []
            for k, t in shape.items():
                v = value.get(k)
                if t == "string" and type(v) is str:
                    out.append(self.add(STRING, v))
                elif t == "u64" and type(v) is int:
                    self.numbers[U64][v] = self.numbers[U64].get(v, 0) + 1
                    out.append((U64, v))
                else:
                    self.put_value(out, v, t)
        else:
            out = []
            self.put_value(out, value, shape)
        return tuple(out)

    def put_value(self, out: list, v, s) -> None:
        if isinstance(s, list):
            v = v if isinstance(v, (list, tuple)) else []
            out.append(len(v))
            for x in v:
                self.put_value(out, x, s[0])
        elif isinstance(s, dict):
            for k, t in s.items():
                self.put_value(out, v.get(k) if isinstance(v, dict) else None, t)
        elif s == "string":
            out.append(self.add(STRING, "" if v is None else v if isinstance(v, str) else json.dumps(v)))
        elif s == "bool":
            out.append(self.refer(U64, 1 if v else 0))
        elif s != "null":
            out.append(self.refer(COLUMN_OF[s], v or 0))

    def write(self) -> bytes:
        out = bytearray()
        rank = {c: {v: i for i, v in enumerate(sorted(n, key=lambda v: (-n[v], v)))} for c, n in self.numbers.items()}
        for s in self.lists[STRING]:
            put_text(out, STRING, s)
        for c, emit in ((U64, put), (I64, lambda o, t, v: put(o, t, zigzag(v))), (F32, put_float), (F64, put_double)):
            for v in rank[c]:
                emit(out, c, v)
        for c in (POINTS, POINTS3D):
            for p in self.lists[c]:
                put_packed(out, c, steps(list(p)))
        for x in self.lists[INDICES]:
            put_packed(out, INDICES, deltas(list(x)))
        for x in self.lists[SHAPES]:
            put_packed(out, SHAPES, [v if isinstance(v, int) else rank[v[0]][v[1]] for v in x])
        for b in self.lists[BBOXES]:
            put_bytes(out, BBOXES, box_bytes(list(b)))
        return bytes(out)


class Cache:
    """The cache of a tile that is read: raw entries, decoded when first asked for."""

    def __init__(self, data: memoryview) -> None:
        self.raw: dict[int, list] = {c: [] for c in range(1, 11)}
        self.known: dict[int, dict[int, object]] = {c: {} for c in range(1, 11)}
        found = runs.read(data)
        if found is not None:
            self.raw |= {c: v for c, v in found.items() if c in self.raw}
            return
        for tag, kind, v in fields(data):
            if tag in self.raw:
                self.raw[tag].append((kind, v))

    def get(self, column: int, index: int):
        known = self.known[column]
        if index not in known:
            kind, v = self.raw[column][index]
            if column == STRING:
                got = bytes(v).decode()
            elif column == U64:
                got = v
            elif column == I64:
                got = unzigzag(v)
            elif column in (F32, F64):
                got = wire.number(kind, v)
            elif column == POINTS:
                got = walk(packed(v), 2)
            elif column == POINTS3D:
                got = walk(packed(v), 3)
            elif column == INDICES:
                got = sums(packed(v))
            elif column == SHAPES:
                got = packed(v)
            else:
                got = box_values(bytes(v))
            known[index] = got
        return known[index]

    def shape(self, index: int):
        numbers = iter(self.get(SHAPES, index))

        def build():
            n = next(numbers)
            if n & 3 == 0:
                return [build()]
            if n & 3 == 1:
                return {self.get(STRING, next(numbers)): build() for _ in range(n >> 2)}
            return TYPES[(n >> 2) - 1]

        return build()

    def value(self, index: int, shape):
        if is_flat(shape):
            row, get = iter(self.get(SHAPES, index)), self.get
            return {k: None if t == "null" else get(U64, next(row)) != 0 if t == "bool" else get(COLUMN_OF[t], next(row)) for k, t in shape.items()}
        numbers = iter(self.get(SHAPES, index))

        def build(s):
            if isinstance(s, list):
                return [build(s[0]) for _ in range(next(numbers))]
            if isinstance(s, dict):
                return {k: build(t) for k, t in s.items()}
            if s == "null":
                return None
            n = next(numbers)
            if s == "bool":
                return self.get(U64, n) != 0
            return self.get({"string": STRING, "u64": U64, "i64": I64, "f32": F32, "f64": F64}[s], n)

        return build(shape)


def is_offset(offsets) -> bool:
    return any(o > 0 for line in offsets or [] for o in line if o is not None)


def write_open_feature(f: dict, shape: dict, mshape: dict | None, cache: Columns) -> bytes:
    kind, geometry = f["type"], f["geometry"] or []
    three, form = kind > 3, (kind - 1) % 3 + 1
    column = POINTS3D if three else POINTS
    lines = [r for p in geometry for r in p]
    has_m = mshape is not None and any(v[3] is not None for r in lines for v in r)
    has_offsets = form > 1 and is_offset(f.get("offsets"))
    single = len(lines[0] if lines else []) == 1 if form == 1 else len(lines if form == 2 else geometry) == 1
    indices, tessellation = (f.get("indices"), f.get("tessellation")) if form == 3 else (None, None)  # polygons alone have them
    place = lambda v: (v[0], v[1], v[2] or 0) if three else (v[0], v[1])

    def line(r) -> list[int]:
        return [cache.add(column, tuple(map(place, r))), *((cache.value(v[3] or {}, mshape) for v in r) if has_m else ())]

    def offset(p: int, r: int) -> list[int]:
        if not has_offsets:
            return []
        try:
            value = f["offsets"][p][r] or 0
        except (IndexError, TypeError):
            value = 0
        if value < 0:
            raise ValueError("an offset must not be negative")
        return [math.floor(value * 1000)]

    out = bytearray()
    flags = (f.get("id") is not None) | (f.get("bbox") is not None) << 1 | has_offsets << 2 | bool(indices) << 3 | bool(tessellation) << 4 | has_m << 5 | single << 6
    wire.put_varint(out, kind)
    wire.put_varint(out, flags)
    if f.get("id") is not None:
        wire.put_varint(out, int(f["id"]))
    wire.put_varint(out, cache.value(f.get("properties") or {}, shape))
    if form == 1:
        points = lines[0] if lines else []
        if single:
            d = [zigzag(v) for v in place(points[0])]
            if max(d) > 65535:
                raise ValueError("a point does not fit 16 bits")
            where = weave(d, SPREAD3 if three else SPREAD2)
        else:
            where = cache.add(INDICES, tuple(line(points)))
    elif form == 2:
        index = [] if single else [len(lines)]
        for r, points in enumerate(lines):
            index += offset(0, r) + line(points)
        where = cache.add(INDICES, tuple(index))
    else:
        index = [] if single else [len(geometry)]
        for p, poly in enumerate(geometry):
            index.append(len(poly))
            for r, points in enumerate(poly):
                index += offset(p, r) + line(points)
        where = cache.add(INDICES, tuple(index))
    wire.put_varint(out, where)
    if indices:
        wire.put_varint(out, cache.add(INDICES, tuple(indices)))
    if tessellation:
        wire.put_varint(out, cache.add(column, tuple(map(place, tessellation))))
    if f.get("bbox") is not None:
        wire.put_varint(out, cache.add(BBOXES, tuple(v for v in f["bbox"] if v is not None)))
    return bytes(out)


def read_open_feature(data: memoryview, fid: int, cache: Cache, shape, mshape, wanted: set[str] | None) -> dict:
    numbers = iter(packed(data))
    want = lambda name: wanted is None or name in wanted
    kind, flags = next(numbers), next(numbers)
    if not 1 <= kind <= 6:
        raise ValueError(f"unknown feature type {kind}")
    has = [bool(flags >> i & 1) for i in range(7)]
    three, form = kind > 3, (kind - 1) % 3 + 1
    column = POINTS3D if three else POINTS
    out = {"fid": fid, "id": next(numbers) if has[0] else None, "type": kind, "properties": None, "geometry": None, "offsets": None, "bbox": None, "indices": None, "tessellation": None}
    where = next(numbers)
    if want("properties"):
        out["properties"] = cache.value(where, shape)
    where = next(numbers)
    vertex = lambda p, m=None: (p[0], p[1], p[2] if three else None, m)
    if want("geometry") or want("offsets"):
        if form == 1 and has[6]:
            n = 3 if three else 2
            out["geometry"] = [[[vertex([unzigzag(squeeze(where >> k, n)) for k in range(n)])]]]
        else:
            index = iter(cache.get(INDICES, where))
            offsets: list[list[float]] = []

            def line() -> list:
                if form > 1:
                    offsets[-1].append(next(index) / 1000 if has[2] else 0.0)
                points = cache.get(column, next(index))
                return [vertex(p, cache.value(next(index), mshape or {}) if has[5] else None) for p in points]

            if form == 1:
                out["geometry"] = [[line()]]
            else:
                polys = 1 if form == 2 or has[6] else next(index)
                out["geometry"] = []
                for _ in range(polys):
                    offsets.append([])
                    count = 1 if form == 2 and has[6] else next(index)
                    out["geometry"].append([line() for _ in range(count)])
                out["offsets"] = offsets
    if form == 3:
        if has[3]:
            out["indices"] = list(cache.get(INDICES, next(numbers)))
        if has[4]:
            out["tessellation"] = [(p[0], p[1], p[2] if three else None) for p in cache.get(column, next(numbers))]
    if has[1]:
        out["bbox"] = cache.get(BBOXES, next(numbers))
    return out


def read_open_layer(data: memoryview, cache: Cache, wanted: set[str] | None = None, layers: set[str] | None = None, only: int | None = None, skip: bool = False, lazy: bool = False) -> dict:
    """As read_mvt_layer, of a columnar layer."""
    layer = {"kind": "open", "version": 1, "layer": "", "extent": 4096, "shape": {}, "mshape": None}
    parts, lists = parts_of(data, (4,))
    raw = lists[4]
    for tag, name, get in ((1, "version", int), (2, "layer", lambda v: cache.get(STRING, v)), (3, "extent", EXTENTS.__getitem__), (5, "shape", cache.shape), (6, "mshape", cache.shape)):
        if tag in parts:
            layer[name] = get(parts[tag])
    layer["n_features"], layer["features"] = len(raw), []
    if lazy and (layers is None or layer["layer"] in layers):
        layer |= {"features": chosen(raw, only, skip), "cache": cache}
    elif layers is None or layer["layer"] in layers:
        layer["features"] = [read_open_feature(f, i, cache, layer["shape"], layer["mshape"], wanted) for i, f in chosen(raw, only, skip)]
    return layer


def write_open_layer(layer: dict, cache: Columns) -> bytes:
    features = layer["features"]
    shape = layer.get("shape") or infer(f.get("properties") for f in features)
    mshape = layer.get("mshape")
    if mshape is None:
        ms = [v[3] for f in features for p in f["geometry"] or [] for r in p for v in r if v[3] is not None]
        mshape = infer(ms) if ms else None
    check_shape(shape)
    out = bytearray()
    put(out, 1, layer.get("version") or 1)
    put(out, 2, cache.add(STRING, layer["layer"] or ""))
    put(out, 3, EXTENTS.index(layer["extent"] or 4096))
    put(out, 5, cache.shape(shape))
    if mshape is not None:
        put(out, 6, cache.shape(mshape))
    for f in sorted(features, key=lambda f: f["type"]):  # stable
        put_bytes(out, 4, write_open_feature(f, shape, mshape, cache))
    return bytes(out)


# Grids and images


def write_grid(grid: dict) -> bytes:
    data, extent = grid["data"], grid["extent"]
    low, high = min(data), max(data)
    mapped = [half_up((v - low) * extent / (high - low)) if high > low else 0 for v in data]
    out = bytearray()
    put(out, 1, extent)
    put(out, 2, grid["size"])
    put_float(out, 3, low)
    put_float(out, 4, high)
    put_packed(out, 5, deltas(mapped))
    put_text(out, 6, grid["name"])
    return bytes(out)


def read_grid(data: memoryview) -> dict:
    """A grid; its data stay delta-encoded numbers of 0..extent, which ``functions.arrays.grid_decode`` maps back."""
    out = {"name": "", "extent": 4096, "size": 0, "min": 0.0, "max": 0.0, "data": []}
    for tag, kind, v in fields(data):
        if tag == 1:
            out["extent"] = EXTENTS[int(wire.number(kind, v))] if wire.number(kind, v) < len(EXTENTS) else int(wire.number(kind, v))
        elif tag == 2:
            out["size"] = int(wire.number(kind, v))
        elif tag in (3, 4):
            out["min" if tag == 3 else "max"] = float(wire.number(kind, v))
        elif tag == 5:
            out["data"] = packed(v)
        elif tag == 6:
            out["name"] = bytes(v).decode()
    return out


def write_image(image: dict) -> bytes:
    out = bytearray()
    put(out, 1, IMAGE_TYPES.index(image["type"]))
    put(out, 2, image["width"])
    put(out, 3, image["height"])
    put_bytes(out, 4, bytes(image["image"]))
    put_text(out, 5, image["name"])
    return bytes(out)


def read_image(data: memoryview) -> dict:
    out = {"name": "", "type": "unknown", "width": 0, "height": 0, "image": b""}
    for tag, _, v in fields(data):
        if tag == 1:
            out["type"] = IMAGE_TYPES[v]
        elif tag in (2, 3):
            out["width" if tag == 2 else "height"] = v
        elif tag == 4:
            out["image"] = bytes(v)
        elif tag == 5:
            out["name"] = bytes(v).decode()
    return out


# Tiles


#: Tags that a reader of row-oriented tiles knows.
ROW_TAGS = (FLAT, MVT)


def read_tile(data: bytes, wanted: set[str] | None = None, layers: set[str] | None = None, rows_only: bool = False, only: int | None = None, skip: bool = False, count: bool = False, lazy: bool = False) -> dict[str, list[dict]]:
    """All of a tile: layers (with features), grids, images. Row-oriented layers without features are left out, and of
    layers, grids or images of one name the last stays. layers: the names of those wanted, the others' features stay
    undecoded. rows_only: any part that isn't a row-oriented layer is an error. only: the index of the feature wanted,
    skip: of layers that have it. count: features are counted, not decoded. lazy: they are left as messages."""
    named = set() if count else layers
    found: dict[str, dict] = {"layers": {}, "grids": {}, "images": {}}
    cache, waiting = None, []
    for tag, _, v in fields(memoryview(data)):
        if tag in ROW_TAGS:
            layer = read_mvt_layer(v, tag == FLAT, wanted, named, only, skip, lazy)
            if layer["n_features"]:
                found["layers"][layer["layer"]] = layer
        elif rows_only:
            raise ValueError(f"unknown tag: {tag}")
        elif tag == OPEN:
            waiting.append(v)
        elif tag == CACHE:
            cache = Cache(v)
        elif tag == GRID:
            grid = read_grid(v)
            found["grids"][grid["name"]] = grid
        elif tag == IMAGE:
            image = read_image(v)
            found["images"][image["name"]] = image
    if waiting and cache is None:
        raise ValueError("a tile with columnar layers has no column cache")
    for v in waiting:
        layer = read_open_layer(v, cache, wanted, named, only, skip, lazy)
        found["layers"][layer["layer"]] = layer
    out = {k: list(v.values()) for k, v in found.items()}
    if layers is not None:
        out["layers"] = [x for x in out["layers"] if x["layer"] in layers]
    return out


def write_tile(layers: list[dict], kind: str = "open", grids: list[dict] = (), images: list[dict] = ()) -> bytes:
    """kind: open (columnar), mvt or flat; grids and images go with a columnar tile."""
    out = bytearray()
    if kind == "open":
        cache = Columns()
        for layer in layers:
            put_bytes(out, OPEN, write_open_layer(layer, cache))
        put_bytes(out, CACHE, cache.write())
    elif kind in ("mvt", "flat"):
        for layer in layers:
            put_bytes(out, MVT if kind == "mvt" else FLAT, write_mvt_layer(layer, kind == "mvt"))
    else:
        raise ValueError(f"unknown tile kind {kind}")
    for image in images:
        put_bytes(out, IMAGE, write_image(image))
    for grid in grids:
        put_bytes(out, GRID, write_grid(grid))
    return bytes(out)
