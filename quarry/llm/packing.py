"""Conflict-constrained best-fit packing of documents into fixed-size training sequences.

Rows are dealt into shards of a bounded number of rows by a hash of all that identifies them, so a hot source or a large
cluster of copies is spread evenly over all shards. Within a shard, items go longest first. Open bins are kept in a list
ordered by (residual, bin); a bin carries one integer bitmap of the sources in it (``per_source`` bits each, filled one
by one) and one of the duplicate clusters. The search begins at the smallest residual that holds the item and walks to
the next larger one until a bin accepts it; if none does, a new bin opens. So each item lands in the tightest compatible
bin. A document longer than a bin is cut: its full parts are bins of their own, the rest is packed like any item.

A cluster of copies may hold a third of all rows: as no bin takes two of them, that many bins must exist, and the walk
past them is what bounds the size of a shard. To keep that walk short, bins that hold a cluster are also counted by
cluster: when the compatible bins are none, it is known without a walk.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
PER_SOURCE = 4
#: Items of a shard, on average; copies of one row that are dealt out in one piece.
SHARD_ROWS, COPIES = 1000, 4096


def pack_shard(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, start) of each item, for items in the order given (longest first for best-fit decreasing)."""
    bins: list[list] = []  # residual, bitmap of sources, bitmap of clusters
    order: list[tuple[int, int]] = []
    seen: dict[int, int] = {}
    out = []
    for length, source, cluster in zip(lengths, sources, clusters):
        slots = ((1 << per_source) - 1) << (source * per_source)
        bit = 1 << cluster
        chosen = None
        if seen.get(cluster, 0) < len(bins):
            for k in range(bisect_left(order, (length, -1)), len(order)):
                b = bins[order[k][1]]
                if not b[2] & bit and b[1] & slots != slots:
                    chosen = order.pop(k)[1]
                    break
        if chosen is None:
            chosen = len(bins)
            bins.append([capacity, 0, 0])
        b = bins[chosen]
        out.append((chosen, capacity - b[0]))
        used = (b[1] & slots) >> (source * per_source)
        b[0] -= length
        b[1] |= (used + 1) << (source * per_source)  # bits fill from the low end: 0, 1, 11, 111
        b[2] |= bit
        seen[cluster] = seen.get(cluster, 0) + 1
        if b[0] > 0:
            insort(order, (b[0], chosen))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS, cluster: str | None = None) -> DataFrame:
    """Places every document of ``docs`` (doc_id, text, source; ids and sources of any type) in bins of ``capacity`` words.

    One row per part of a document: doc_id, source, cluster, part, n_words, bin (its name), start within the bin, fill (words
    in that bin). Words are runs of characters other than white space. A null or empty text has one part of no words, which
    also gets a place. A null source is a source of its own, a null id an id like any other. Rows repeated exactly stay
    separate items, of one cluster: no bin holds two parts with the same text. Near copies share a cluster only where
    ``cluster`` names a column that tells it (as component_id of near.classes()); rows that have null in it go by their text.
    A bin holds at most ``per_source`` items of one source. Ties go by doc_id, cluster and ordinal. An empty table gives no
    rows. Other columns are ignored.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    own = own if cluster is None else F.when(F.col(cluster).isNull(), own).otherwise(F.xxhash64(cluster))
    # Rows repeated exactly are counted first and dealt out by their ordinal: one hash key can't hold many rows.
    rows = cut(docs.select("doc_id", "source", own.alias("cluster"), words.alias("total")).groupBy("doc_id", "source", "cluster", "total").agg(F.count("*").alias("copies")))
    n_full = F.floor(F.col("total") / capacity)
    n_rest = rows.where((F.col("total") % capacity != 0) | (F.col("total") == 0)).agg(F.sum("copies")).first()[0] or 0
    shards = max(1, -(-n_rest // shard_rows))
    few = rows.where(F.col("copies") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    # A row with very many copies is dealt out in blocks of ordinals, which the tasks share.
    many = rows.where(F.col("copies") > COPIES).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))).repartition("cluster", "block")
    many = many.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least(F.col("copies"), (F.col("block") + 1) * COPIES)))).drop("block")
    items = few.unionByName(many)
    keys = ("doc_id", "source", "cluster", "copy")
    whole = items.where(n_full > 0).select(*keys, F.explode(F.sequence(F.lit(0), n_full.cast("int") - 1)).alias("part"))
    # A name's hash covers all that tells one full part from another, nulls written out.
    name = F.concat(F.lit("f-"), F.substring(F.sha2(F.to_json(F.struct("doc_id", "source", F.hex("cluster").alias("cluster"), "copy", "part"), {"ignoreNullFields": "false"}), 256), 1, 32))
    whole = whole.select("doc_id", "source", "cluster", "part", F.lit(capacity).cast("long").alias("n_words"), name.alias("bin"), F.lit(0).cast("long").alias("start"), F.lit(capacity).cast("long").alias("fill"))
    rest = items.where((F.col("total") % capacity != 0) | (F.col("total") == 0)).select(*keys, n_full.cast("int").alias("part"), (F.col("total") % capacity).alias("n_words"))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "copy"), F.lit(shards)))
    return rest.groupBy("shard").applyInArrow(placer(capacity, per_source), whole.schema).unionByName(whole)


def placer(capacity: int, per_source: int) -> Callable[[pa.Table], pa.Table]:
    """A function from a shard's items, as an Arrow table, to their places; ids and sources are never converted."""

    def coded(column: pa.ChunkedArray) -> list[int]:
        made = column.combine_chunks().dictionary_encode()
        return pc.fill_null(made.indices, len(made.dictionary)).to_pylist()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), *((c, "ascending") for c in ("doc_id", "cluster", "source", "copy"))])
        at = pack_shard(table.column("n_words").to_pylist(), coded(table.column("source")), coded(table.column("cluster")), capacity, per_source)
        fill: dict[int, int] = {}
        for (b, _), n in zip(at, table.column("n_words").to_pylist()):
            fill[b] = fill.get(b, 0) + n
        shard = table.column("shard")[0].as_py()
        made = {"bin": pa.array([f"s{shard}-{b}" for b, _ in at]), "start": pa.array([x for _, x in at], pa.int64()), "fill": pa.array([fill[b] for b, _ in at], pa.int64())}
        return pa.table({c: table.column(c) for c in ("doc_id", "source", "cluster", "part", "n_words")} | made)

    return place
