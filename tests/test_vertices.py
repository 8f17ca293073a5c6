"""Tiles from a row for each vertex: the bytes of the features that the vertices make, with no JSON between."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest

from quarry.operators import encode
from quarry.sources import bulk


def both(n: int = 400, holes: bool = False, deep: bool = False) -> tuple[pa.Table, pa.Table]:
    """Features and their vertices: points in two layers, lines of one to four vertices in a third."""
    features, vertices = [], []
    for i in range(n):
        line = i % 3 == 0
        props = {"a": i % 7 if line else i, "q": i / 8, "w": float(i % 5), "s": f"ü{i % 4}", "t": i % 2 == 0, "neg": -(i % 6), "none": None}
        if holes and i % 5 == 1:
            props["q"] = None
        size = 1 + i % 4 if line else 1
        kind = (2 if line else 1) + (3 if deep else 0)
        if line and size == 1:
            kind -= 1
        head = {"layer": "line" if line else f"p{i % 2}", "fid": (i * 37) % n, "id": None if i % 11 == 5 else i}
        z = i % 9 if deep else None
        points = [{"x": i + k, "y": 3 * i - k, "z": z, "m": {"q": (i + k) % 5, "u": "x" if k else None} if line and i % 6 else None} for k in range(size)]
        text = lambda m: None if m is None else json.dumps({k: v for k, v in m.items() if v is not None}, separators=(",", ":"))
        known = {k: v for k, v in props.items() if v is not None} | ({"n": size} if kind % 3 == 2 else {})
        features.append(head | {"type": kind, "properties": json.dumps(known), "geometry": [[[{**v, "m": text(v["m"])} for v in points]]], "offsets": [[i % 3 / 4]] if line else None})
        for k, v in reversed(list(enumerate(points))):
            m = v["m"] or {"q": None, "u": None}
            vertices.append(head | {"type": (2 if line else 1) + (3 if deep else 0), "x": v["x"], "y": v["y"], "z": v["z"], "o:pos": k, "offset": i % 3 / 4 if line else None, **{f"p:{c}": x for c, x in props.items()}, **{f"m:{c}": x for c, x in m.items()}})
    vertex = pa.struct([("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("m", pa.string())])
    schema = pa.schema([("layer", pa.string()), ("fid", pa.int32()), ("id", pa.decimal128(20, 0)), ("type", pa.int32()), ("properties", pa.string()), ("geometry", pa.list_(pa.list_(pa.list_(vertex)))), ("offsets", pa.list_(pa.list_(pa.float64())))])
    return pa.Table.from_pylist(features, schema=schema), pa.Table.from_pylist(vertices)


@pytest.mark.parametrize("kind", ["mvt", "flat", "open"])
@pytest.mark.parametrize("how", [{}, {"holes": True}, {"deep": True}])
def test_the_same_bytes_as_features(kind, how, monkeypatch):
    features, vertices = both(**how)
    want = encode._tile(features, {}, kind, ("p1", "void"))
    monkeypatch.setattr(json, "loads", None)
    layers = bulk.vertex_layers(vertices, ["o:pos"], "point", "n", kind == "open")
    assert bulk.write_layers(layers, kind, {}, ("p1", "void")) == want


def test_lone_vertices_of_lines_go():
    _, vertices = both()
    kept, dropped = (bulk.vertex_layers(vertices, ["o:pos"], lone, None, True) for lone in ("keep", "drop"))
    assert kept["line"].n - dropped["line"].n == sum(i % 4 == 0 for i in range(0, 400, 3))
    assert bulk.vertex_layers(vertices.filter(pa.compute.field("layer") == "line").slice(0, 1), ["o:pos"], "drop", None, True) == {}


def test_numbers_that_are_not_finite_are_errors():
    _, vertices = both()
    at = vertices.column_names.index("p:q")
    with pytest.raises(ValueError):
        bulk.vertex_layers(vertices.set_column(at, "p:q", pa.array([float("nan")] * vertices.num_rows)), ["o:pos"], "keep", None, True)


@pytest.mark.parametrize("kind", ["mvt", "flat"])
def test_a_layer_is_written_some_features_at_a_time(kind, monkeypatch):
    features, vertices = both()
    want, held = encode._tile(features, {}, kind), []
    monkeypatch.setattr(bulk, "SLICE", 16)
    messages = bulk.messages
    monkeypatch.setattr(bulk, "messages", lambda tag, n, blocks: held.append(n if tag == 2 else 0) or messages(tag, n, blocks))
    assert encode._tile(features, {}, kind) == want
    assert bulk.write_layers(bulk.vertex_layers(vertices, ["o:pos"], "point", "n", False), kind, {}) == want
    assert max(held) <= 16
