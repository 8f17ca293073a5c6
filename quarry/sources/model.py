"""Schemas of tiles, layers, features, grids and images as DataFrames.

A geometry is always array<polygon: array<ring: array<vertex>>>: points are one ring of one polygon, lines the rings of
one polygon. Properties and m-values are JSON texts (``parse_json`` makes them VARIANT); types are 1 points, 2 lines,
3 polygons, and 4 to 6 the same in three dimensions.
"""

from __future__ import annotations

from pyspark.sql import types as T

GEOMETRY_NAMES = ("points", "lines", "polygons", "points3d", "lines3d", "polygons3d")

LONG, INT, TEXT, DOUBLE = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


VERTEX = struct(x=LONG, y=LONG, z=LONG, m=TEXT)
GEOMETRY = T.ArrayType(T.ArrayType(T.ArrayType(VERTEX)))
BBOX = struct(left=DOUBLE, bottom=DOUBLE, right=DOUBLE, top=DOUBLE, near=DOUBLE, far=DOUBLE)

LAYERS = struct(layer_ord=INT, kind=TEXT, version=INT, layer=TEXT, extent=INT, shape=TEXT, mshape=TEXT, n_features=INT)
PLAIN_FEATURES = struct(layer=TEXT, kind=TEXT, extent=INT, fid=INT, id=T.DecimalType(20, 0), type=INT, properties=TEXT)
FEATURES = T.StructType([
    *PLAIN_FEATURES,
    *struct(geometry=GEOMETRY, offsets=T.ArrayType(T.ArrayType(DOUBLE)), bbox=BBOX, indices=T.ArrayType(LONG), tessellation=T.ArrayType(struct(x=LONG, y=LONG, z=LONG))),
])
GRIDS = struct(name=TEXT, extent=INT, size=INT, min=DOUBLE, max=DOUBLE, data=T.ArrayType(LONG))
IMAGES = struct(name=TEXT, type=TEXT, width=INT, height=INT, image=T.BinaryType())


#: What features may also tell of their layer, where it is named.
OF_LAYER = struct(shape=TEXT, mshape=TEXT)


def feature_schema(columns: list[str] | None = None) -> T.StructType:
    """The columns of features after tile_id, all or those named (shape and mshape of their layer only if named); the parser
    skips what isn't asked for."""
    return FEATURES if columns is None else T.StructType([f for f in [*FEATURES, *OF_LAYER] if f.name in columns])
