"""Fields of a protobuf message a run at a time: those with the same tag one after another, as layers and caches have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from . import wire

#: Bytes of a run of numbers that are looked at together: few at first, as a run may be one number, then four times as many.
FIRST, MOST = 64, 1 << 16


class Entries:
    """Messages or fixed numbers of a buffer, as a list of (wire type, view); or numbers of varints, as (0, number)."""

    def __init__(self, kind: int, buffer: memoryview) -> None:
        self.kind, self.buffer = kind, buffer
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.parts: list[np.ndarray] = []

    @property
    def numbers(self) -> np.ndarray:
        if len(self.parts) != 1:
            self.parts = [np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)]
        return self.parts[0]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each begins and its length."""
        starts = np.fromiter(self.starts, np.int64, len(self.starts))
        return starts, np.fromiter(self.ends, np.int64, len(self.ends)) - starts

    def __len__(self) -> int:
        return sum(map(len, self.parts)) if self.kind == wire.VARINT else len(self.starts)

    def __getitem__(self, i: int) -> tuple[int, object]:
        if self.kind == wire.VARINT:
            return self.kind, int(self.numbers[i])
        return self.kind, self.buffer[self.starts[i] : self.ends[i]]

    def __iter__(self) -> Iterator[tuple[int, object]]:
        if self.kind == wire.VARINT:
            return iter([(0, v) for v in self.numbers.tolist()])
        kind, b = self.kind, self.buffer
        return iter([(kind, b[p:q]) for p, q in zip(self.starts, self.ends)])


def varints(b: np.ndarray, at: int, key: int, room: int) -> tuple[np.ndarray, int]:
    """The numbers of fields with this key (of one byte) one after another, as many as room bytes hold, and where they end."""
    part = b[at : at + room]
    ends = np.flatnonzero(part < 128)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    n = len(ends) // 2
    wrong = np.flatnonzero((part[starts[: 2 * n : 2]] != key) | (ends[: 2 * n : 2] != starts[: 2 * n : 2]))
    n = int(wrong[0]) if len(wrong) else n
    if not n:
        raise IndexError("a varint ends with its message")
    starts, ends = starts[1 : 2 * n : 2], ends[1 : 2 * n : 2]
    width = ends - starts + 1
    if width.max() > 10:
        raise ValueError("a varint is longer than ten bytes")
    v = (part[starts] & 127).astype(np.uint64)
    for k in range(1, width.max()):
        more = width > k
        v[more] |= (part[starts[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return v, at + int(ends[-1]) + 1


def read(data: memoryview) -> dict[int, Entries] | None:
    """All fields by tag, each tag's in their order; None where a tag is of several bytes or comes with several wire types."""
    data = memoryview(data)
    raw, b = bytes(data), np.frombuffer(data, np.uint8)
    at, n, out = 0, len(raw), {}
    while at < n:
        key = raw[at]
        kind, tag = key & 7, key >> 3
        if key > 127:
            return None
        found = out.get(tag)
        if found is None:
            found = out[tag] = Entries(kind, data)
        elif found.kind != kind:
            return None
        if kind == wire.BYTES:
            starts, ends = found.starts.append, found.ends.append
            while at < n and raw[at] == key:
                size = raw[at + 1]
                at += 2
                if size > 127:
                    size, at = wire.varint(raw, at - 1)
                starts(at)
                at += size
                ends(at)
            if at > n:
                raise ValueError("a field runs past the end of its message")
        elif kind == wire.VARINT:
            room = FIRST
            while at < n and raw[at] == key:
                v, at = varints(b, at, key, room)
                found.parts.append(v)
                room = min(4 * room, MOST)
        elif kind in (wire.FIXED32, wire.FIXED64):
            width = 5 if kind == wire.FIXED32 else 9
            if at + width > n:
                raise ValueError("a field runs past the end of its message")
            wrong = np.flatnonzero(b[at:n:width][: (n - at) // width] != key)
            k = int(wrong[0]) if len(wrong) else (n - at) // width
            found.starts += range(at + 1, at + k * width, width)
            found.ends += range(at + width, at + k * width + 1, width)
            at += k * width
        else:
            raise ValueError(f"unknown wire type {kind}")
    return out
