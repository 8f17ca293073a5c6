"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame expressions only.

Containment is measured against the item, the short side, so it is the item that has a MinHash signature, and the whole
document that is searched, however long: a signature of a document of 20,000 words says nothing of 25 shingles in it.
Items are partitioned by the number of their shingles (powers of two). A partition fixes the length of its signatures, the
least hash values of an item's shingles. The share of an item's signature that a document holds estimates the containment;
a pair is a candidate if the estimate is no less than what a share ``threshold`` of all shingles leaves at worst: as many
values may be missing as shingles may. So the search has no false negatives (recall 1 by construction), and what the
estimate lets pass is verified by exact containment of all shingles.

Words are runs of characters other than ASCII punctuation, white space and controls, with A-Z lowered. A shingle is
``n`` words; an item of fewer words is one shingle of all of them and is searched among shingles of that length. Items
without words, and null or empty texts, match nothing. Rows count by (doc_id, text): repeated rows give one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .common import ascii_lower, cut, fresh, is_small
from .licenses import SEPARATORS

N, THRESHOLD = 5, 0.8
#: Rows of items (their signatures, their shingles) that are broadcast at most; beyond, the joins shuffle.
BROADCAST_ROWS = 200_000
#: The sieve before a shuffle: so many bitmaps of as many bits, 16 MB whatever the items.
BITMAPS, BITS = 4096, 32_768


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n words; the words' own hashes are given. Empty where there are fewer."""
    at = F.when(F.size(hashes) >= n, F.sequence(F.lit(0), F.size(hashes) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(hashes, i + k) for k in range(n)]))


def item_table(items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """A row per item and distinct shingle: item_id, variant (of its words), width, h, size, need (shingles to share), signed
    (whether h is in the signature), agree (values of the signature to share)."""
    base = items.select("item_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("wh")).where(F.size("wh") > 0).distinct()
    width = F.least(F.size("wh"), F.lit(n))
    by = F.coalesce(*[F.when(width == k, F.sort_array(F.array_distinct(shingles(F.col("wh"), k)))) for k in range(1, n + 1)])
    base = base.select("item_id", width.alias("width"), by.alias("hs"), F.xxhash64("wh").alias("variant"))
    size = F.size("hs")
    need = F.ceil(size * F.lit(threshold) - 1e-9).cast("int")
    # A partition's signatures are twice as long as what may be missing in its largest items: half of them, or more, agree.
    upper = F.pow(F.lit(2), F.ceil(F.log2(size.cast("double")))).cast("int")
    length = F.least(size, 2 * (upper - F.floor(upper * threshold).cast("int") + 1))
    base = base.select("item_id", "variant", "width", size.alias("size"), need.alias("need"), length.alias("length"), (length - (size - need)).alias("agree"), F.posexplode("hs").alias("at", "h"))
    return base.withColumn("signed", F.col("at") < F.col("length")).drop("at", "length")


def doc_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """docs (key, text, ...) with a row for each distinct shingle of each width: width, h. Words are hashed once for all widths."""
    hashes = F.transform(words(F.col("text")), lambda w: F.xxhash64(w))
    of = lambda wh: F.concat(*[F.transform(F.array_distinct(shingles(wh, n)), lambda h: F.struct(F.lit(n).alias("width"), h.alias("h"))) for n in widths])  # noqa: B023, E731
    keys = [c for c in docs.columns if c != "text"]
    return docs.select(*keys, F.explode(let(hashes, of)).alias("s")).select(*keys, "s.width", "s.h")


def sieved(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of found whose h may be in wanted, by broadcast bitmaps of a fixed size; few others pass."""
    slot, bit = F.pmod("h", F.lit(BITMAPS)), F.pmod(F.shiftright("h", 20), F.lit(BITS))
    maps = wanted.select(slot.alias("slot"), bit.alias("bit")).groupBy("slot").agg(F.bitmap_construct_agg("bit").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return found.withColumns({"slot": slot, "bit": bit}).join(F.broadcast(maps), "slot").where(held).drop("slot", "bit", "bits")


def contained(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it contains at least ``threshold``: doc_id, item_id, n_shared, size,
    containment, and row_key (a hash of doc_id and text). Items without an id (null) are told apart by their words; a null
    doc_id is an id like any other. Without items or documents there are no pairs. Extra columns of either table are ignored."""
    table = cut(item_table(items, n, threshold))
    widths = sorted(r[0] for r in table.select("width").distinct().collect())  # at most n values
    empty = table.limit(0).select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "item_id", F.lit(None).cast("long").alias("row_key"), F.lit(0).cast("long").alias("n_shared"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("containment"))
    if not widths:
        return empty
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    signed = table.where("signed").select("item_id", "variant", "width", "h", "agree")
    # The key alone goes on: documents that nothing is found in never leave their task.
    parts = doc_shingles(keyed.select("row_key", "text"), widths)
    parts = parts.join(F.broadcast(signed), ["width", "h"]) if is_small(signed, BROADCAST_ROWS) else sieved(parts, signed).join(signed, ["width", "h"])
    near = cut(parts.groupBy("row_key", "item_id", "variant", "agree").agg(F.count("*").alias("hits")).where("hits >= agree").select("row_key", "item_id", "variant"))
    suspects = keyed.join(near.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
    found = near.toDF("row_key2", "item_id2", "variant2")
    same = F.col("item_id").eqNullSafe(F.col("item_id2")) & (F.col("variant") == F.col("variant2"))
    if is_small(table, BROADCAST_ROWS):
        exact = doc_shingles(suspects, widths).join(F.broadcast(table), ["width", "h"]).join(found, (F.col("row_key") == F.col("row_key2")) & same, "left_semi")
    else:
        wanted = found.join(table, same).select(F.col("row_key2").alias("row_key"), *table.columns)
        exact = doc_shingles(suspects, widths).join(wanted, ["row_key", "width", "h"])
    counts = exact.groupBy("doc_id", "row_key", "item_id", "variant", "size", "need").agg(F.count("*").alias("n_shared")).where("n_shared >= need")
    unnamed = F.when(F.col("item_id").isNull(), F.col("variant")).alias("unnamed")
    best = counts.groupBy("doc_id", "item_id", "row_key", unnamed).agg(F.max(F.struct((F.col("n_shared") / F.col("size")).alias("containment"), "n_shared", F.col("size").cast("long").alias("size"))).alias("b"))
    return best.select("doc_id", "item_id", "row_key", "b.n_shared", "b.size", "b.containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that contain an item; the others stay as they are, repeated ones too, with all their columns."""
    (key,) = fresh(docs, "row_key")
    bad = contained(docs, items, n, threshold).select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("doc_id", "text")).join(bad, key, "left_anti").drop(key)
