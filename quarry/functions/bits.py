"""Scalar kernels of the tile formats as Column expressions (BIGINT throughout, so ANSI mode never overflows).

All run inside whole-stage codegen and work inside lambdas. Two's-complement quantities stay within the widths that the
formats give them; what a format would silently wrap is masked here on purpose and said so.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats: extents and their codes, type codes of shapes, image types.
EXTENTS = (512, 1024, 2048, 4096, 8192, 16384)
SHAPE_TYPES = ("string", "u64", "i64", "f32", "f64", "bool", "null")
IMAGE_TYPES = ("png", "jpg", "webp", "gif", "avif", "svg", "bmp", "raw", "unknown")
MAX24 = 16_777_215


def _long(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c) if isinstance(c, int) else F.col(c)).cast("bigint")


def half_up(c: Column) -> Column:
    """Rounding with halves towards positive infinity."""
    return F.floor(c + 0.5).cast("bigint")


def command_encode(cmd, length) -> Column:
    return F.shiftleft(_long(length), 3).bitwiseOR(_long(cmd).bitwiseAND(F.lit(7).cast("bigint")))


def command_decode(c) -> Column:
    c = _long(c)
    return F.struct(c.bitwiseAND(F.lit(7).cast("bigint")).alias("cmd"), F.shiftright(c, 3).alias("length"))


def zigzag(c) -> Column:
    c = _long(c)
    return F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 63))


def zagzig(c) -> Column:
    c = _long(c)
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("bigint"))))


@functools.cache
def _table(values: tuple[int, ...]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _group(c: Column, first: int, size: int) -> Column:
    """The number in ``size`` bits of c from bit ``first`` on."""
    return F.shiftright(c, first).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")).cast("int")


def _bits(value: Column, every: int, at: int) -> Column:
    """The 16 low bits of value set apart, bit i at place every * i + at: two lookups, one for each byte."""
    table = _table(tuple(sum(((v >> i) & 1) << (every * i + at) for i in range(8)) for v in range(256)))
    return F.get(table, _group(value, 0, 8)).bitwiseOR(F.shiftleft(F.get(table, _group(value, 8, 8)), 8 * every))


def _gather(value: Column, every: int, at: int) -> Column:
    """The 16 bits of value at places every * i + at, put together: a lookup for each group of ``every`` times three or four."""
    step = 4 if every == 2 else 3
    table = _table(tuple(sum(((v >> (every * i + at)) & 1) << i for i in range(step)) for v in range(1 << (every * step))))
    out = None
    for i in range(0, 16, step):
        part = F.shiftleft(F.get(table, _group(value, every * i, every * step)), i)
        out = part if out is None else out.bitwiseOR(part)
    return out


def weave2d(a, b) -> Column:
    """Two 16-bit numbers interleaved to 32 bits, a on the even ones."""
    return _bits(_long(a), 2, 0).bitwiseOR(_bits(_long(b), 2, 1))


def unweave2d(c) -> Column:
    c = _long(c)
    return F.struct(_gather(c, 2, 0).alias("a"), _gather(c, 2, 1).alias("b"))


def weave3d(a, b, c) -> Column:
    """Three 16-bit numbers interleaved to 48 bits."""
    return _bits(_long(a), 3, 0).bitwiseOR(_bits(_long(b), 3, 1)).bitwiseOR(_bits(_long(c), 3, 2))


def unweave3d(c) -> Column:
    c = _long(c)
    return F.struct(_gather(c, 3, 0).alias("a"), _gather(c, 3, 1).alias("b"), _gather(c, 3, 2).alias("c"))


def quantize_lon(deg) -> Column:
    return half_up(((F.col(deg) if isinstance(deg, str) else deg).cast("double") + 180.0) * MAX24 / 360.0)


def dequantize_lon(q) -> Column:
    return (F.col(q) if isinstance(q, str) else q).cast("double") * 360.0 / MAX24 - 180.0


def quantize_lat(deg) -> Column:
    return half_up(((F.col(deg) if isinstance(deg, str) else deg).cast("double") + 90.0) * MAX24 / 180.0)


def dequantize_lat(q) -> Column:
    return (F.col(q) if isinstance(q, str) else q).cast("double") * 180.0 / MAX24 - 90.0


def pack24(c) -> Column:
    """The low 24 bits, big-endian."""
    return F.unhex(F.lpad(F.hex(_long(c).bitwiseAND(F.lit(MAX24).cast("bigint"))), 6, "0"))


def unpack24(data: Column, at: int = 1) -> Column:
    """The 24-bit number at byte ``at`` (from 1) of a binary."""
    return F.conv(F.hex(F.substring(data, at, 3)), 16, 10).cast("bigint")


def pack_float(c: Column) -> Column:
    """The bytes of a 32-bit float, little-endian: built from sign, exponent and fraction, as no builtin gives them.

    Not-a-number is written as the quiet one; infinities and subnormals keep their own bits.
    """
    v = c.cast("float").cast("double")
    # A negative zero equals zero; its text tells it apart.
    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), F.lit(1 << 31).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    size = F.abs(v)
    # The exponent comes from a logarithm, which may be one off next to a power of two, and is put right by comparison.
    guess = F.greatest(F.floor(F.log2(F.when(size > 0, size).otherwise(F.lit(1.0)))).cast("int"), F.lit(-126))
    up = F.when(size >= F.pow(F.lit(2.0), guess + 1), 1).when((size < F.pow(F.lit(2.0), guess)) & (guess > -126), -1).otherwise(0)
    e = guess + up
    subnormal = size < 2.0**-126
    fraction = F.when(subnormal, size / 2.0**-149).otherwise((size / F.pow(F.lit(2.0), e) - 1.0) * float(1 << 23)).cast("bigint")
    normal = F.when(subnormal, fraction).otherwise(F.shiftleft((e + 127).cast("bigint"), 23) + fraction)
    bits = F.when(F.isnan(v), F.lit(0x7FC00000).cast("bigint")).when(size == float("inf"), sign + F.lit(0x7F800000).cast("bigint")).when(size == 0, sign).otherwise(sign + normal)
    big = F.lpad(F.hex(bits), 8, "0")
    return F.unhex(F.concat(*[F.substring(big, k, 2) for k in (7, 5, 3, 1)]))


def unpack_float(data: Column, at: int = 1) -> Column:
    """The 32-bit float whose little-endian bytes begin at byte ``at``, as a double."""
    big = F.concat(*[F.hex(F.substring(data, at + k, 1)) for k in (3, 2, 1, 0)])
    bits = F.conv(big, 16, 10).cast("bigint")
    sign = F.when(bits.bitwiseAND(F.lit(1 << 31).cast("bigint")) != 0, -1.0).otherwise(1.0)
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(255).cast("bigint"))
    fraction = bits.bitwiseAND(F.lit((1 << 23) - 1).cast("bigint")).cast("double")
    return F.when((exponent == 255) & (fraction > 0), float("nan")).when(exponent == 255, sign * float("inf")).when(exponent == 0, sign * fraction * 2.0**-149).otherwise(sign * (1.0 + fraction / float(1 << 23)) * F.pow(F.lit(2.0), exponent - 127))


def encode_offset(c: Column) -> Column:
    """Thousandths, rounded down; a negative offset is an error."""
    return F.when(c < 0, F.raise_error(F.lit("an offset must not be negative")).cast("bigint")).otherwise(F.floor(c * 1000).cast("bigint"))


def decode_offset(c: Column) -> Column:
    return c.cast("double") / 1000


def _index(values: tuple, c: Column, what: str, first: int = 0) -> Column:
    case = None
    for i, v in enumerate(values):
        case = F.when(c == v, i + first) if case is None else case.when(c == v, i + first)
    return case.when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), c.cast("string"))).cast("int"))


def _value(values: tuple, c: Column, what: str, first: int = 0) -> Column:
    kind = "string" if isinstance(values[0], str) else "int"
    case = None
    for i, v in enumerate(values):
        case = F.when(c == i + first, v) if case is None else case.when(c == i + first, v)
    return case.when(c.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"invalid {what}: "), c.cast("string"))).cast(kind))


def encode_extent(c: Column) -> Column:
    return _index(EXTENTS, c, "extent")


def decode_extent(c: Column) -> Column:
    return _value(EXTENTS, c, "extent code")


def encode_attribute(kind: Column, count: Column) -> Column:
    """kind: 0 array, 1 object, 2 primitive; count: of an object's keys, or a primitive's type code."""
    return F.shiftleft(count.cast("bigint"), 2) + kind.cast("bigint")


def decode_attribute(c: Column) -> Column:
    return F.struct(c.bitwiseAND(F.lit(3).cast("bigint")).alias("kind"), F.shiftright(c, 2).alias("count"))


def shape_type_code(c: Column) -> Column:
    return _index(SHAPE_TYPES, c, "shape type", 1)


def shape_type_name(c: Column) -> Column:
    return _value(SHAPE_TYPES, c, "shape type code", 1)


def image_type_code(c: Column) -> Column:
    return _index(IMAGE_TYPES, c, "image type")


def image_type_name(c: Column) -> Column:
    return _value(IMAGE_TYPES, c, "image type code")


def elevation_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def elevation_rgb(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) * 0.1 - 10000.0


def transform_point(x: Column, y: Column, z: Column | None, extent, m: Column | None = None) -> Column:
    """A point of the unit square (cube) on an extent's grid; a missing z is 0 in three dimensions."""
    e = extent if isinstance(extent, Column) else F.lit(extent)
    parts = [half_up(x * e).alias("x"), half_up(y * e).alias("y")]
    if z is not None:
        parts.append(half_up(F.coalesce(z, F.lit(0.0)) * e).alias("z"))
    if m is not None:
        parts.append(m.alias("m"))
    return F.struct(*parts)
