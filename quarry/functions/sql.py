"""The scalar kernels as SQL functions, for use on columns in spark.sql (SQL functions can't be called inside lambdas)."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments, result, body.
FUNCTIONS = (
    ("tile_zigzag", "v BIGINT", "BIGINT", "shiftleft(v, 1) ^ shiftright(v, 63)"),
    ("tile_zagzig", "v BIGINT", "BIGINT", "shiftrightunsigned(v, 1) ^ -(v & 1)"),
    ("tile_command_encode", "cmd BIGINT, len BIGINT", "BIGINT", "shiftleft(len, 3) | (cmd & 7)"),
    ("tile_command_decode", "c BIGINT", "STRUCT<cmd: BIGINT, length: BIGINT>", "named_struct('cmd', c & 7, 'length', shiftright(c, 3))"),
    ("tile_weave2d", "a BIGINT, b BIGINT", "BIGINT", "aggregate(sequence(0, 15), 0L, (r, i) -> r | shiftleft(shiftright(a, i) & 1, 2 * i) | shiftleft(shiftright(b, i) & 1, 2 * i + 1))"),
    ("tile_weave3d", "a BIGINT, b BIGINT, c BIGINT", "BIGINT", "aggregate(sequence(0, 15), 0L, (r, i) -> r | shiftleft(shiftright(a, i) & 1, 3 * i) | shiftleft(shiftright(b, i) & 1, 3 * i + 1) | shiftleft(shiftright(c, i) & 1, 3 * i + 2))"),
    ("tile_quantize_lon", "d DOUBLE", "BIGINT", "floor((d + 180.0D) * 16777215 / 360.0D + 0.5D)"),
    ("tile_quantize_lat", "d DOUBLE", "BIGINT", "floor((d + 90.0D) * 16777215 / 180.0D + 0.5D)"),
    ("tile_dequantize_lon", "q BIGINT", "DOUBLE", "q * 360.0D / 16777215 - 180.0D"),
    ("tile_dequantize_lat", "q BIGINT", "DOUBLE", "q * 180.0D / 16777215 - 90.0D"),
    ("tile_elevation_terrarium", "r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "r * 256.0D + g + b / 256.0D - 32768.0D"),
    ("tile_elevation_rgb", "r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "(r * 65536 + g * 256 + b) * 0.1D - 10000.0D"),
)


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in this session; gives their names."""
    for name, args, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
