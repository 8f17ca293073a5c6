"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points lowered by the word rules: A-Z only, every other character stays.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is configured and all runs on this machine a fresh temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@functools.cache
def _at_end(application: str) -> None:
    """Has the application's folder removed when the driver ends."""

    def remove() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext.applicationId == application and spark.sparkContext._jsc is not None:
            with contextlib.suppress(Py4JError, OSError):
                _delete(spark, _folder(spark))

    atexit.register(remove)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written as a table in the shared folder, from where every executor can read it again.

    The driver then collects its garbage, upon which Spark removes the shuffle files of what is done; else they stay on
    the executors' disks until the driver's heap happens to fill.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    _at_end(spark.sparkContext.applicationId)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Removes the table that cut() wrote for df, where nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quarry-" in path:
            _delete(df.sparkSession, path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows whose Python objects a worker holds at once, and the bytes from which on it holds fewer.
ROWS, ROW_BYTES = 512, 8 << 20


def slices(batch: pa.RecordBatch, rows: int, size: int = ROW_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most ``rows`` rows, and of ``size`` bytes unless one row alone has more."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.slice(at, n).nbytes > size:
            n = (n + 1) // 2
        yield batch.slice(at, n)
        at += n


def map_batches(df: DataFrame, schema: T.StructType | str, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = ROWS) -> DataFrame:
    """mapInArrow with a function built once per task (caches and automata live as long as the task's batches).

    ``make()`` gives a function from a batch to columns (lists, numpy or Arrow arrays) by the names of ``schema``. It is
    called on slices of at most ``rows`` rows (fewer long ones), and their results go out at once, which bounds a worker's
    memory.
    """
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in (part for b in batches for part in slices(b, rows)):
            got = step(batch)
            arrays = [x.cast(f.type) if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for x, f in zip((got[f.name] for f in arrow), arrow)]
            yield pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=arrow)

    return df.mapInArrow(run, schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def ascii_lower(c):
    return F.translate(c, UPPER, LOWER)


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined with one, an aggregate by these very keys, so that a hot key's rows can be shared by several tasks.

    Joined on the keys alone, both sides would lie as the aggregate does, and Spark can't split such partitions. A hash of
    the keys as one more key has both sides dealt for this join only; adaptive execution then splits what is too large.
    """
    (extra,) = fresh(many.select(*many.columns, *[F.lit(0).alias(c) for c in one.columns if c not in many.columns]), "dealt")
    deal = F.xxhash64(*keys)
    return many.withColumn(extra, deal).join(one.withColumn(extra, deal), [*keys, extra], how).drop(extra)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most ``rows`` rows; reads no more than that many plus one."""
    return df.limit(rows + 1).count() <= rows
