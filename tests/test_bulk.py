"""The array forms of the codec against its plain forms: the same bytes, the same rows, and no work value by value."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quarry.operators import encode
from quarry.sources import bulk, codec, model, tiles

SCHEMA = to_arrow_schema(T.StructType([T.StructField("tile_id", T.StringType()), *model.FEATURES]))


def vertex(x, y, z=None, m=None):
    return {"x": x, "y": y, "z": z, "m": m}


def geometry(kind: int, i: int, with_m: bool, parts: int) -> list:
    z = i % 30 if kind > 3 else None
    m = lambda k: json.dumps({"w": k % 5, "t": f"ä{k % 3}"}) if with_m else None
    form = (kind - 1) % 3 + 1
    if form == 1:
        return [[[vertex(i % 900 - 40 + k, 7 * i % 800, z, m(k)) for k in range(parts)]]]
    s = 3 + i % 5
    ring = [vertex(i, i, z, m(0)), vertex(i + s, i, z, m(1)), vertex(i + s, i + s, z, m(2)), vertex(i, i, z, m(3))]
    return [[ring] * parts] if form == 2 else [[ring, ring[::-1]]] * parts


def table(kinds: list[int], n: int = 300) -> pa.Table:
    rows = []
    for i in range(n):
        kind = kinds[i % len(kinds)]
        props = {"a": i, "b": -i if i % 9 == 5 else i, "c": i / 4, "d": f'text "{i % 7}" ü', "e": i % 2 == 0}
        rows.append({
            "layer": f"l{i % 3}", "fid": i, "id": None if i % 11 == 3 else i * 1000, "type": kind, "extent": 4096,
            "properties": None if i % 13 == 7 else json.dumps(props if i % 3 else dict(list(props.items())[: 1 + i % 5])),
            "geometry": geometry(kind, i, i % 4 == 1, 1 + i % 2), "offsets": [[i % 3 / 2.0] * (1 + i % 2)] * (1 + i % 2) if kind % 3 != 1 else None,
            "indices": [i, 3, 1] if i % 5 == 0 else None, "tessellation": [{"x": i, "y": 2, "z": 5}] if i % 6 == 0 else None,
            "bbox": dict(zip(bulk.BOX_NAMES, (-10.5, 2.0, 30.25, 40.0, *((1.0, 2.0) if kind > 3 else (None, None))))) if i % 7 == 2 else None,
        })
    fields = [f for f in SCHEMA if f.name not in ("tile_id", "kind", "id")] + [pa.field("id", pa.decimal128(20, 0))]
    return pa.Table.from_pylist([{**r} for r in rows], schema=pa.schema(fields)).sort_by([("layer", "ascending"), ("fid", "ascending")])


def plain_rows(data: bytes, **how) -> list[dict]:
    return tiles.feature_batch(codec.read_tile(data, set(SCHEMA.names), **how), SCHEMA, "tile_id", "t").to_pylist()


@pytest.mark.parametrize("kinds", [[1], [2], [3], [1, 2, 3, 4, 5, 6]])
@pytest.mark.parametrize("kind", ["mvt", "flat", "open"])
def test_same_tiles_and_rows(kind, kinds):
    t = table(kinds)
    data = bulk.write_tile(t, kind, {}, ("l1", "void"))
    want = codec.write_tile(encode._layers(t, {}, ("l1", "void")), kind)
    assert plain_rows(data) == plain_rows(want)
    if kind != "open":
        assert data == want
    for how in ({}, {"layers": {"l1"}}, {"only": 3, "skip": True}):
        got = [r for b in bulk.batches(data, SCHEMA, "tile_id", "t", **how) for r in b.to_pylist()]
        assert got == plain_rows(want, **how)


@pytest.mark.parametrize("kind", ["mvt", "flat", "open"])
def test_no_parse_for_each_feature(kind, monkeypatch):
    calls = []
    loads = json.loads
    monkeypatch.setattr(json, "loads", lambda s: calls.append(1) or loads(s))
    encode._tile(table([1]), {}, kind)
    assert len(calls) <= 6  # one or two a layer, not one a feature


def test_large_layers_go_out_in_pieces():
    t = table([1], 3 * bulk.SLICE + 5)
    got = list(bulk.batches(bulk.write_tile(t, "mvt", {}), SCHEMA, "tile_id", "t"))
    assert max(b.num_rows for b in got) <= bulk.SLICE
    assert sum(b.num_rows for b in got) == t.num_rows


def test_odd_features_take_the_plain_way():
    t = table([1], 10).to_pylist()
    t[3]["geometry"] = None
    t[4]["properties"] = '{"deep": {"x": [1, 2]}}'
    t[5]["geometry"] = [[[]]]
    odd = pa.Table.from_pylist(t, schema=table([1], 10).schema)
    with pytest.raises(bulk.Odd):
        bulk.write_tile(odd, "mvt", {}, ())
    data = encode._tile(odd, {}, "mvt")
    assert [r for b in bulk.batches(data, SCHEMA, "tile_id", "t") for r in b.to_pylist()] == plain_rows(data)
    nested = odd.slice(4, 1)
    for kind in ("mvt", "open"):
        data = encode._tile(nested, {}, kind)
        assert [r for b in bulk.batches(data, SCHEMA, "tile_id", "t") for r in b.to_pylist()] == plain_rows(data)


@pytest.mark.parametrize("kind", ["mvt", "open"])
def test_broken_tiles_are_errors(kind):
    data = bulk.write_tile(table([1, 2, 3]), kind, {}, ())
    with pytest.raises((ValueError, IndexError, KeyError)):
        list(bulk.batches(data[: len(data) - 9], SCHEMA, "tile_id", "t"))


@pytest.mark.parametrize("made", ["mvt", "open"])
def test_transcoding_by_arrays(made):
    data = bulk.write_tile(table([1, 2, 3]), made, {}, ())
    for kind in ("open", "mvt"):
        got = bulk.rewrite(codec.read_tile(data, lazy=True)["layers"], kind, False)
        want = codec.write_tile([{**x, "shape": None if x["kind"] != "open" else x["shape"]} for x in codec.read_tile(data)["layers"]], kind)
        assert plain_rows(got) == plain_rows(want)
    with pytest.raises(bulk.Odd):  # nothing left: the plain way writes the empty tile
        bulk.rewrite(codec.read_tile(bulk.write_tile(table([1]), "open", {}, ()), lazy=True)["layers"], "open", True)


def rows_of(data: bytes) -> list[dict]:
    return [r for b in bulk.batches(data, SCHEMA, "tile_id", "t") for r in b.to_pylist()]


@pytest.mark.parametrize("kind", ["mvt", "flat"])
def test_polygons_are_read_without_a_walk_for_each(kind, monkeypatch):
    data = bulk.write_tile(table([2, 3, 6]), kind, {}, ())
    want = plain_rows(data)
    monkeypatch.setattr(codec, "commands", None)
    assert rows_of(data) == want


@pytest.mark.parametrize("kinds", [[2], [3], [2, 3, 5, 6]])
def test_columnar_features_without_a_step_for_each(kinds, monkeypatch):
    t = table(kinds)
    want = plain_rows(bulk.write_tile(t, "open", {}, ()))
    calls = []
    add, get = codec.Columns.add, codec.Cache.get
    monkeypatch.setattr(codec.Columns, "add", lambda self, column, key: calls.append(1) if column == codec.INDICES else add(self, column, key))
    monkeypatch.setattr(codec.Cache, "get", lambda self, column, i: calls.append(1) if column == codec.INDICES else get(self, column, i))
    assert rows_of(bulk.write_tile(t, "open", {}, ())) == want
    assert not calls


@pytest.mark.parametrize("kind", ["mvt", "flat", "open"])
def test_one_feature_far_longer_than_the_others(kind):
    t = table([3], 40).to_pylist()
    ring = [vertex(0, 0), vertex(2, 0), vertex(2, 2), vertex(0, 0)]
    t[5]["geometry"] = [[[{**v, "x": v["x"] + i % 500} for v in ring]] for i in range(3000)]
    t[6]["geometry"] = [[ring[:1] * 4, ring, ring[::-1], ring[:1] * 3, ring]]  # rings without area
    long = pa.Table.from_pylist(t, schema=table([3], 40).schema)
    data = bulk.write_tile(long, kind, {}, ())
    assert rows_of(data) == plain_rows(data) == plain_rows(codec.write_tile(encode._layers(long, {}), kind))


def test_lists_of_indices_that_end_early():
    with pytest.raises(IndexError):
        bulk.ring_lists(*(np.array(v) for v in ([2, 1, 0], [0, 3], [3], [False], [False], [False], [False])), {False: np.array([0, 4]), True: np.array([0])})


@pytest.mark.parametrize("kind", ["mvt", "flat", "open"])
def test_typed_values(kind, monkeypatch):
    t = table([1, 2])
    data = bulk.write_tile(t, kind, {}, ())
    want = [json.loads(r["properties"]) for r in plain_rows(data)]
    fields = pa.struct([("a", pa.int64()), ("c", pa.float64()), ("d", pa.string()), ("e", pa.bool_()), ("none", pa.int32())])
    schema = pa.schema([("tile_id", pa.string()), ("layer", pa.string()), ("values", fields)])
    monkeypatch.setattr(json, "dumps", None)
    monkeypatch.setattr(bulk, "text_of", None)
    got = [r["values"] for b in bulk.batches(data, schema, "tile_id", "t") for r in b.to_pylist()]
    assert got == [{k: r.get(k) for k in ("a", "c", "d", "e", "none")} for r in want]
    wrong = pa.schema([("values", pa.struct([("c", pa.int64())]))])
    with pytest.raises(ValueError):
        list(bulk.batches(data, wrong, "tile_id", "t"))


def test_typed_values_of_nested_properties():
    t = table([1], 10).to_pylist()
    t[4]["properties"] = '{"deep": {"x": [1, 2]}, "a": 3}'
    odd = pa.Table.from_pylist(t, schema=table([1], 10).schema)
    schema = pa.schema([("values", pa.struct([("a", pa.int64())]))])
    got = [r["values"]["a"] for b in bulk.batches(encode._tile(odd, {}, "open"), schema, "tile_id", "t") for r in b.to_pylist()]
    want = [json.loads(r["properties"])["a"] for r in plain_rows(encode._tile(odd, {}, "open"))]
    assert got == want


def test_boxes_without_a_step_for_each(monkeypatch):
    boxes = [(-10.5, 2.0, 30.25, 40.0), (-10.5, 2.0, 30.25, 40.0, 1.0, 2.0), (0.0, -0.0, 0.0, 0.0), (-180.0, -90.0, 180.0, 90.0, -1.5, 0.1), (200.0, 95.0, -181.0, -91.0)]
    plain = [codec.box_bytes(list(b)) for b in boxes]
    odd = [[(1.0, 2.0, 3.0, 4.0, 5.0)], [(1.0, 2.0, 3.0, 4.0, float("inf"), float("nan"))], [(1e300, 2.0, 3.0, 4.0)]]
    want = [b"".join(bytes((82, len(x))) + x for b in v for x in [codec.box_bytes(list(b))]) for v in odd]
    assert [bulk.box_fields(v) for v in odd] == want
    read = [(*codec.box_values(b), None, None)[:6] for b in plain]
    for name in ("box_bytes", "box_values"):
        monkeypatch.setattr(codec, name, lambda b: pytest.fail("a box by itself"))
    data = bulk.box_fields(boxes)
    assert data == b"".join(bytes((82, len(b))) + b for b in plain)
    assert list(zip(*[a.to_pylist() for a in bulk.box_axes(bulk.runs.read(memoryview(data))[10])])) == read
    assert bulk.box_fields([]) == b""


def test_places_of_boxes():
    values = [(1.0, 2.0, 3.0, 4.0, None, None), (0.0, 2.0, 3.0, 4.0, None, None), None, (-0.0, 2.0, 3.0, 4.0, None, None), (1.0, 2.0, 3.0, 4.0, 0.0, 0.0), (1.0, 2.0, 3.0, 4.0, None, None)]
    for more in ([], [(1.0, 2.0, 3.0, 4.0, 0.0, None)], [(1.0, float("nan"), 3.0, 4.0, None, None)]):
        rows = values + more
        column = pa.array([v and dict(zip(bulk.BOX_NAMES, v)) for v in rows], SCHEMA.field("bbox").type)
        found, known = {(1.0, 2.0, 3.0, 4.0, 0.0, 0.0): 0}, {(1.0, 2.0, 3.0, 4.0, 0.0, 0.0): 0}
        got = bulk.box_places(column, column.is_valid().to_numpy(zero_copy_only=False), found)
        assert got.tolist() == [known.setdefault(tuple([x for x in v if x is not None]), len(known)) for v in rows if v]
        assert repr(list(found)) == repr(list(known))


def test_pieces_of_several_layers_are_kept_once():
    one, more = (pa.array(v, pa.large_binary()) for v in ([b"a", b"b" * 200, b""], [b"c", b"a"]))
    first, both = bulk.Columns(), bulk.Columns()
    assert first.piece_places(codec.POINTS, one).tolist() == both.piece_places(codec.POINTS, one).tolist() == [0, 1, 2]
    assert both.piece_places(codec.POINTS, more).tolist() == [3, 0]
    plain = lambda pieces: b"".join(bytes((codec.POINTS << 3 | 2,)) + bulk.varint(len(b)) + b for b in pieces)
    assert first.write() == plain(one.to_pylist()) and both.write() == plain([*one.to_pylist(), b"c"])
