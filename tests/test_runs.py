"""Messages read a run at a time give the fields that they give one by one."""

from __future__ import annotations

import pytest

from quarry.sources import codec, runs, wire


def message() -> bytes:
    out = bytearray()
    wire.put(out, 5, 4096)
    for i in range(300):
        wire.put_bytes(out, 4, b"x" * i)
    for i in range(5000):
        wire.put(out, 2, i * i * i)
    wire.put(out, 5, 1)
    for i in range(40):
        wire.put_double(out, 3, i / 4)
        wire.put_float(out, 6, i / 2) if i % 3 else None
    wire.put_bytes(out, 4, b"")
    wire.put(out, 2, (1 << 64) - 1)
    return bytes(out)


def test_same_fields():
    want: dict[int, list] = {}
    for tag, kind, v in wire.fields(memoryview(message())):
        want.setdefault(tag, []).append((kind, v))
    got = runs.read(message())
    assert {t: list(v) for t, v in got.items()} == want
    assert all([v[i] for i in range(len(v))] == want[t] for t, v in got.items())


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_messages_that_end_early_are_errors(cut):
    with pytest.raises((ValueError, IndexError)):
        runs.read(message()[:-cut])


def test_what_has_no_runs_is_read_field_by_field():
    out = bytearray()
    wire.put(out, 1, 7)
    wire.put_text(out, 1, "seven")
    assert runs.read(bytes(out)) is None
    wire.put_text(out, 1000, "far")
    assert codec.Cache(memoryview(bytes(out))).raw[1] == [(0, 7), (2, memoryview(b"seven"))]


def test_a_cache_is_read_without_a_step_for_each_number(monkeypatch):
    out = bytearray()
    for i in range(20000):
        wire.put(out, codec.U64, i)
    monkeypatch.setattr(codec, "fields", None)
    cache = codec.Cache(memoryview(bytes(out)))
    assert cache.get(codec.U64, 19999) == 19999 and len(cache.raw[codec.U64]) == 20000
