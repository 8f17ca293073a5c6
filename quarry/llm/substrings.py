"""Exact repeated byte strings by bucket-pointer refinement.

The strings that count are those of LENGTH bytes at every position of every text. They are never sorted one by one:

1. Initial buckets. A position's first bucket is the least hashed q-gram inside its string, a function of the string
   alone. Neighbouring positions share it, so a text falls into runs of some 85 positions with one bucket, and only runs
   are dealt out. A bucket with a single occurrence of its q-gram over the whole corpus is settled: nothing repeats.
2. Runs with the same bytes fall into one window. If a bucket's windows are all one, its members are settled: all repeat.
3. The other buckets' distinct windows are refined by their strings. Bucket identifiers of all positions start from q-grams
   and are refined by sorting on the pair (identifier here, identifier at a later offset): q, 2q, 4q, ... bytes, each
   refinement reusing the identifiers of the last one; positions alone in their bucket leave at once. What is left when
   the strings are LENGTH long repeats.
4. A bucket with more than CROWD distinct windows (one q-gram in very many contexts) isn't refined in one task. There the
   identifiers are 128-bit names and are refined by shuffles with partial aggregation, so no bucket's size matters: first
   those of whole cells (positions that are up to CELL steps apart, counted from the q-gram, so that equal texts have equal
   cells), then, of one cell for each name, those of its strings. A cell that repeats settles all its strings.

Runs are cut at MAX_RUN positions, so windows stay short whatever the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, map_batches, mix

LENGTH, GRAM = 200, 32
MAX_RUN, CROWD, CELL = 512, 4096, 16
#: Bytes of windows that are refined together.
BLOCK = 4 << 20


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` (a power of two) bytes, by doubling."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < size:
        h = mix(h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ np.uint64(step)))
        step *= 2
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_max_back(x: np.ndarray, width: int, n: int) -> np.ndarray:
    """For m < n the largest of x[m-width+1 .. m] that exists."""
    return ~sliding_min(~np.concatenate([np.zeros(width - 1, np.uint64), x, np.zeros(n - len(x), np.uint64)]), width)


def text_runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first position, positions) of each run, and (bucket, occurrences of its q-gram) of the text."""
    if len(raw) < length:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none.view(np.uint64), none
    h = gram_hashes(np.frombuffer(raw, np.uint8), gram)
    width = length - gram + 1
    low = sliding_min(h, width)
    chosen = sliding_max_back(low, width, len(h)) == h
    values, counts = np.unique(h[chosen], return_counts=True)
    edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.concatenate([edge, [len(low)]]))
    if len(size) and size.max() > MAX_RUN:
        pieces = -(-size // MAX_RUN)
        start = np.repeat(edge, pieces) + MAX_RUN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        end = np.minimum(np.repeat(edge + size, pieces), start + MAX_RUN)
        edge, size = start, end - start
    return low[edge], edge, size, values, counts


def refine(windows: list[bytes], length: int) -> list[np.ndarray]:
    """For each window the starts of its strings of ``length`` bytes that start elsewhere in these windows too."""
    data = np.frombuffer(b"".join(windows), np.uint8)
    sizes = np.array([len(w) for w in windows])
    ends = np.cumsum(sizes)
    # Positions whose string lies inside their window; only they are wanted, all later offsets they need are inside too.
    room = np.repeat(ends, sizes) - np.arange(len(data))
    inside = room >= length
    have = 1
    while 2 * have <= min(length, GRAM):
        have *= 2
    first = np.concatenate([gram_hashes(data, have), np.zeros(have - 1, np.uint64)])
    bucket = np.unique(first, return_inverse=True)[1].astype(np.int64)
    while have < length:
        step = min(have, length - have)
        # A position alone in its bucket is settled: its identifier stays, and stays good as a pointer.
        due = np.flatnonzero((np.bincount(bucket)[bucket] > 1) & (room >= have + step))
        top = bucket.max() + 1
        bucket[due] = top + np.unique(bucket[due] * top + bucket[due + step], return_inverse=True)[1]
        have += step
    mine = np.flatnonzero(inside)
    again = mine[np.bincount(bucket[mine])[bucket[mine]] > 1]
    cuts = np.searchsorted(again, ends)
    return [x - start for x, start in zip(np.split(again, cuts[:-1]), ends - sizes)]


def ranges(starts: np.ndarray) -> list[dict]:
    """Sorted positions as (first, count) runs."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.concatenate([[True], np.diff(starts) > 1]))
    size = np.diff(np.concatenate([edge, [len(starts)]]))
    return [{"first": int(starts[e]), "count": int(n)} for e, n in zip(edge, size)]


RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("count", T.IntegerType())]))


def cells(raw: bytes, bucket: int, length: int) -> list[tuple[int, int]]:
    """(first, count) of a window's cells. They lie by their distance to the window's q-gram; where it occurs several times,
    each position is a cell of its own."""
    count = len(raw) - length + 1
    at = np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8), GRAM).view(np.int64) == bucket)
    if len(at) != 1:
        return [(p, 1) for p in range(count)]
    cell = (at[0] - np.arange(count)) // CELL
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return list(zip(edge.tolist(), np.diff(np.concatenate([edge, [count]])).tolist()))


def _by_cells(pieces: DataFrame, length: int, found: T.StructType) -> DataFrame:
    """bucket, window, ranges of the windows (bucket, window, n, bytes) of crowded buckets."""
    as_long = lambda v: np.array(v, np.uint64).view(np.int64)

    def name(raw: bytes) -> tuple[int, int]:
        both = xxhash.xxh3_128_intdigest(raw)
        return both >> 64, both & 0xFFFFFFFFFFFFFFFF

    def cut_cells():
        def step(batch):
            rows = []
            for bucket, window, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                rows += [(bucket, window, n, first, count, *name(part), part) for first, count in cells(raw, bucket, length) for part in (raw[first : first + count + length - 1],)]
            c = list(zip(*rows)) or [[]] * 8
            return {"bucket": c[0], "window": c[1], "n": c[2], "first": c[3], "count": c[4], "a": as_long(c[5]), "b": as_long(c[6]), "bytes": c[7]}

        return step

    made = cut(map_batches(pieces, "bucket long, window long, n long, first int, count int, a long, b long, bytes binary", cut_cells))
    kinds = cut(made.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min(F.struct("bucket", "window", "first", "count", "bytes")).alias("one")).select("a", "b", "n", "one.*"))
    whole = made.join(kinds.where("n > 1").select("a", "b"), ["a", "b"], "left_semi").select("bucket", "window", F.array(F.struct("first", "count")).alias("ranges"))

    def cut_strings():
        def step(batch):
            out = {k: [] for k in ("bucket", "window", "at", "n", "alone", "a", "b")}
            for n, bucket, window, first, count, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                got = [name(raw[i : i + length]) for i in range(count)]
                out["a"] += [a for a, _ in got]
                out["b"] += [b for _, b in got]
                out["at"] += range(first, first + count)
                for k, v in (("bucket", bucket), ("window", window), ("n", n), ("alone", n == 1)):
                    out[k] += [v] * count
            return out | {"a": as_long(out["a"]), "b": as_long(out["b"])}

        return step

    strings = map_batches(kinds.select("n", "bucket", "window", "first", "count", "bytes"), "bucket long, window long, at int, n long, alone boolean, a long, b long", cut_strings)
    again = strings.groupBy("a", "b").agg(F.sum("n").alias("m")).where("m > 1").select("a", "b")
    hits = strings.where("alone").join(again, ["a", "b"], "left_semi").groupBy("bucket", "window").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def ranger():
        return lambda batch: {"bucket": batch.column(0), "window": batch.column(1), "ranges": [ranges(np.array(x, np.int64)) for x in batch.column(2).to_pylist()]}

    return whole.unionByName(map_batches(hits, found, ranger))


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row_key (hash of doc_id and text), ranges: positions at which a string begins that begins elsewhere too.

    Rows are those of docs that have any, one for each row key; a text that several rows share repeats as a whole.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64("text").alias("content"), F.col("text"))
    # Rows repeated exactly (one key) still count as several: n of them.
    def make():
        def step(batch):
            keys, buckets, firsts, sizes, hows, seen = [], [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or "").encode()
                low, first, size, values, counts = text_runs(raw, length)
                keys.append(np.full(len(low), key, np.int64))
                buckets.append(low.view(np.int64))
                firsts.append(first)
                sizes.append(size)
                hows.extend(xxhash.xxh3_64_intdigest(raw[f : f + s + length - 1]) for f, s in zip(first.tolist(), size.tolist()))
                seen.append(counts[np.searchsorted(values, low)] if len(low) else counts)
            # An occurrence belongs to several runs of one text at most when its runs were cut or it recurs: both mean "look closer".
            cat = lambda x, t: np.concatenate([np.empty(0, t), *x])
            return {"row_key": cat(keys, np.int64), "bucket": cat(buckets, np.int64), "first": cat(firsts, np.int64), "count": cat(sizes, np.int64), "window": np.array(hows, np.uint64).view(np.int64), "seen": np.minimum(cat(seen, np.int64), 2)}

        return step

    runs = map_batches(keyed.select("row_key", "text"), "row_key long, bucket long, first int, count int, window long, seen byte", make)
    runs = cut(runs)
    # Buckets in which anything can repeat: several runs, or a q-gram that occurs twice in one text.
    buckets = runs.groupBy("bucket").agg(F.count("*").alias("c"), F.max("seen").alias("seen")).where("c > 1 or seen > 1").select("bucket", (F.col("seen") > 1).alias("again"))
    live = cut(runs.join(buckets, "bucket"))
    drop(runs)
    # One row for each bucket and window, counted before the shuffle, so a passage of many documents is one row a task; the
    # joins by bucket have no aggregate of that key above them, so a hot bucket's partition can be split.
    kinds = cut(live.groupBy("bucket", "window").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min(F.struct("row_key", "first", "count")).alias("one")))
    mixed = kinds.groupBy("bucket").agg(F.count("*").alias("m"), F.max("again").alias("again")).where("m > 1 or again").select("bucket", (F.col("m") > CROWD).alias("crowded"))
    plain = live.join(mixed.select("bucket"), "bucket", "left_anti").select("row_key", "first", "count")
    # Distinct windows of mixed buckets, one run standing for each.
    windows = cut(kinds.join(mixed, "bucket").select("bucket", "window", "n", "crowded", "one.*"))
    asked = windows.groupBy("row_key").agg(F.collect_list(F.struct("bucket", "window", "n", "first", "count", "crowded")).alias("asked"))
    texts = keyed.select("row_key", "text").join(asked, "row_key").dropDuplicates(["row_key"]).select("asked", "text")

    def cutter():
        def step(batch):
            out = {k: [] for k in ("bucket", "window", "n", "crowded", "bytes")}
            for asked, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for a in asked:
                    for k in ("bucket", "window", "n", "crowded"):
                        out[k].append(a[k])
                    out["bytes"].append(raw[a["first"] : a["first"] + a["count"] + length - 1])
            return out

        return step

    pieces = cut(map_batches(texts, "bucket long, window long, n long, crowded boolean, bytes binary", cutter))

    # Small buckets meet in one task, sorted, and are refined in blocks of whole buckets.
    def refiner(batches):
        schema = pa.schema([("bucket", pa.int64()), ("window", pa.int64()), ("ranges", pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())])))])

        def flush(rows):
            if not rows:
                return
            # A string's bucket depends on the string alone, so those of other buckets can't equal it.
            got = refine([r[3] for r in rows], length)
            out = []
            for (bucket, window, n, data), starts in zip(rows, got):
                whole = n > 1
                out.append((bucket, window, [{"first": 0, "count": len(data) - length + 1}] if whole else ranges(starts)))
            out = [o for o in out if o[2]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held > BLOCK and rows and rows[-1][0] != row[0]:
                    yield from flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3])
        yield from flush(rows)

    found_type = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("window", T.LongType()), T.StructField("ranges", RANGES)])
    small = pieces.where("not crowded").select("bucket", "window", "n", "bytes").repartition("bucket").sortWithinPartitions("bucket", "window").mapInArrow(refiner, found_type)

    large = _by_cells(pieces.where("crowded").select("bucket", "window", "n", "bytes"), length, found_type)
    found = small.unionByName(large)
    mixed = live.select("bucket", "window", "row_key", F.col("first").alias("base")).join(found, ["bucket", "window"])
    mixed = mixed.select("row_key", F.explode("ranges").alias("r"), "base").select("row_key", (F.col("base") + F.col("r.first")).alias("first"), F.col("r.count").alias("count"))
    # Rows repeated exactly have one key: what they name several times is taken once before anything is gathered.
    return plain.unionByName(mixed).distinct().groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("first", "count"))).alias("ranges"))


def cover(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of raw, and the maximal runs removed, when every string that begins in a span is covered."""
    runs: list[list[int]] = []
    for first, count in sorted(spans):
        end = first + count + length - 1
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([first, end])
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), [(a, b) for a, b in runs]


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay.

    A null or empty text has no bytes, nothing removed and the hash of nothing. Rows repeated exactly, and equal texts of
    several ids, repeat each other: all their strings of ``length`` bytes go. Null ids are ids like any other; other columns
    are ignored; an empty table gives no rows."""
    found = repeated(docs, length)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text").join(found, "row_key", "left").select("doc_id", "text", "ranges")

    def make():
        def step(batch):
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode()
                left, runs = cover(raw, [(r["first"], r["count"]) for r in found or ()], length)
                n.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(len(runs))
                kept.append(hashlib.sha256(left).hexdigest())
            return {"doc_id": batch.column(0), "n_bytes": n, "n_removed": removed, "n_spans": spans, "kept_sha256": kept}

        return step

    return map_batches(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", make)
