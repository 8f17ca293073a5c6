"""The protobuf wire format: reading fields from bytes and writing them. No Spark here."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
MASK64 = (1 << 64) - 1


def varint(data, at: int) -> tuple[int, int]:
    """(value, position after it) of the unsigned varint at ``at``."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & MASK64, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint is longer than ten bytes")


def fields(data: memoryview) -> Iterator[tuple[int, int, object]]:
    """(tag, wire type, value) of each field: an int, or a memoryview for length-delimited and fixed ones."""
    at, end = 0, len(data)
    while at < end:
        key, at = (data[at], at + 1) if data[at] < 128 else varint(data, at)
        kind = key & 7
        if kind == BYTES:
            size = data[at]
            at += 1
            if size > 127:
                more = data[at]
                size, at = (size & 127 | more << 7, at + 1) if more < 128 else varint(data, at - 1)
            value = data[at : at + size]
            at += size
            if at > end:
                raise ValueError("a field runs past the end of its message")
        elif kind == VARINT:
            value = data[at]
            at += 1
            if value > 127:
                value, at = varint(data, at - 1)
        elif kind == FIXED32 or kind == FIXED64:
            size = 4 if kind == FIXED32 else 8
            value, at = data[at : at + size], at + size
            if at > end:
                raise ValueError("a field runs past the end of its message")
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, kind, value


def packed(data: memoryview) -> list[int]:
    raw = bytes(data)
    if raw.isascii():  # every number is one byte
        return list(raw)
    out, value, shift = [], 0, 0
    for byte in raw:
        if byte < 128:
            out.append(value | byte << shift if shift < 63 else (value | byte << shift) & MASK64)
            value = shift = 0
        else:
            value |= (byte & 127) << shift
            shift += 7
            if shift > 63:
                raise ValueError("a varint is longer than ten bytes")
    if shift:
        raise IndexError("a varint ends with its message")
    return out


def unzigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def zigzag(n: int) -> int:
    return n << 1 if n >= 0 else ((-n) << 1) - 1


def number(kind: int, value) -> float:
    """A number by its wire type: a varint as it is, a float or double by its bytes."""
    if kind == VARINT:
        return value
    return struct.unpack("<f" if kind == FIXED32 else "<d", value)[0]


def put_varint(out: bytearray, n: int) -> None:
    if n < 0:
        n &= MASK64
    while n > 127:
        out.append((n & 127) | 128)
        n >>= 7
    out.append(n)


def put(out: bytearray, tag: int, value: int) -> None:
    put_varint(out, tag << 3 | VARINT)
    put_varint(out, value)


def put_bytes(out: bytearray, tag: int, value: bytes) -> None:
    put_varint(out, tag << 3 | BYTES)
    put_varint(out, len(value))
    out += value


def put_text(out: bytearray, tag: int, value: str) -> None:
    put_bytes(out, tag, value.encode())


def put_packed(out: bytearray, tag: int, values: Iterable[int]) -> None:
    values = values if isinstance(values, (list, tuple)) else list(values)
    if not values or (max(values) < 128 and min(values) >= 0):
        put_bytes(out, tag, bytes(values))
        return
    body = bytearray()
    for v in values:
        if 0 <= v < 128:
            body.append(v)
        else:
            put_varint(body, v)
    put_bytes(out, tag, body)


def put_float(out: bytearray, tag: int, value: float) -> None:
    put_varint(out, tag << 3 | FIXED32)
    out += struct.pack("<f", value)


def put_double(out: bytearray, tag: int, value: float) -> None:
    put_varint(out, tag << 3 | FIXED64)
    out += struct.pack("<d", value)
