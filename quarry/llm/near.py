"""N-gram Jaccard join by grouped prefixes.

A document's set holds the 64-bit hashes of its distinct n-word shingles. All sets share one order of their elements:
hashes ascending, but the most frequent ones last (a table of at most HEAVY hashes, counted over all documents batch by
batch; any order gives the same links, this one keeps posting lists short). Of two sets that link, the first
|x| - ceil(t |x|) + l elements of each share l at least, and sizes differ by a factor of 1/t at most.

1. Documents with equal sets become one member; members with equal prefixes (of l = SHARED, fewer for small sets) and sizes
   become one group. The l of a group is the least over all partners' sizes. Only groups are indexed, so copies and many near copies cost one posting each.
2. How many groups hold an element of their prefixes is counted. A group with fewer than l elements that others hold too
   has no partner and is done. The others drop their l - 1 most frequent elements: by the order of those counts the
   shared elements' first is still there. So common words rarely make a posting, and no pair was made to learn this.
3. Posting lists name candidate pairs of groups that pass the size filter. Candidates are expanded to members and must
   share l elements of their prefixes, by 16-bit fingerprints (equal elements have equal ones, so none is lost). What is
   left is verified on whole sets, which are read again for those members alone.
4. Components are all that is wanted of a list's members, not all their pairs. So a list is first searched as a star (each
   member against one hub of about its size, another hub in each round); pairs inside a component are then settled, and
   only pairs across components are expanded further. Lists that are still crowded are split by a second element first:
   two sets that share l > 1 elements of their prefixes share the second of them too, and it comes as early. Links between
   different texts that could join two components are never lost; pairs within one component aren't all listed.

Sets are told apart by (size, 64-bit hash of the set).
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop, fresh, is_small, map_batches, mix, spread_join
from .components import components

#: Bound of the broadcast table of frequent hashes (8 bytes each).
HEAVY = 1 << 16
#: Elements that partners' prefixes share at least; fewer for small sets.
SHARED = 16
#: Keys of members that are broadcast to find their texts, at most (16 bytes each); beyond, texts and keys shuffle.
KEYS = 1 << 18
#: A hash counts towards the frequent ones from so many sets of one batch on.
BATCH_MIN, BATCH_ROWS = 4, 4096
#: Another round of stars follows while pairs across components would be more than so many a member, and the last round
#: linked at least that share of the members; rounds at most.
CROSS, USEFUL, ROUNDS = 512, 0.01, 10
#: Members of a component in one list up to which they are few; groups in one list up to which it isn't crowded.
FEW, CROWDED = 8, 128


#: Whether a byte is ASCII white space; a random number for each byte; the base of the words' polynomial and its inverse.
SPACE = np.isin(np.arange(256), np.frombuffer(b"\t\n\x0b\x0c\r ", np.uint8))
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
BASE = 0xE7037ED1A0B428DB
GAP = re.compile(rb"[\t-\r ]")
PIECE = 1 << 20


@functools.cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 .. size - 1, and the inverses, modulo 2^64."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        out.append(np.multiply.accumulate(factors))
    return tuple(out)


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word (run of bytes that are no white space): a polynomial over its bytes, from prefix sums, mixed."""
    out, at = [], 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):  # pieces end at white space, so no word is cut
            gap = GAP.search(raw, end)
            end = gap.start() if gap else len(raw)
        data = np.frombuffer(raw[at:end], np.uint8)
        solid = np.zeros(len(data) + 2, bool)
        solid[1:-1] = ~SPACE[data]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = edge[::2], edge[1::2]
        up, down = powers(1 << max(16, len(data).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * down[first]))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def hasher(n: int) -> Callable[[str | None], np.ndarray]:
    """A function from a text to its sorted distinct shingle hashes."""
    factor = np.uint64(0x9E3779B97F4A7C15)

    def shingles(text: str | None) -> np.ndarray:
        ids = word_hashes((text or "").encode().lower())  # of bytes, lower() takes A-Z only
        if not len(ids):
            return ids
        width = min(n, len(ids))
        h = ids[: len(ids) - width + 1] + np.uint64(width)
        for k in range(1, width):
            h = h * factor + ids[k : len(ids) - width + 1 + k]
        h = mix(h)
        h.sort()
        first = np.empty(len(h), bool)
        first[0] = True
        np.not_equal(h[1:], h[:-1], out=first[1:])
        return h[first]

    return shingles


def prefix_length(size: int, percent: int) -> int:
    """Elements of a set's prefix, of which partners share shared(length) at least."""
    first = size - -(-percent * size // 100) + 1
    return min(size, first - 1 + min(SHARED, first))


def shared(size: int, length: int, other: int, other_length: int, percent: int) -> int:
    """What the prefixes of two sets that link share at least, by their sizes and the prefixes' lengths.

    They share same = ceil(percent (size + other) / (100 + percent)) elements. Of the shared ones the l-th by the order lies
    among the first size - same + l of either set.
    """
    same = -(-percent * (size + other) // (100 + percent))
    return min(length - size + same, other_length - other + same)


def least_shared(percent: int) -> list[int]:
    """What the prefixes of a set and of any partner share at least (SHARED at most), by the set's size; larger sizes are as the last.

    A partner may be smaller and have a shorter prefix, so this may be less than what sets of one size share.
    """
    out = [0]
    while True:
        size = len(out)
        low, high = -(-percent * size // 100), 100 * size // percent
        mine = prefix_length(size, percent)
        out.append(min(SHARED, *(shared(size, mine, y, prefix_length(y, percent), percent) for y in range(low, high + 1))))
        # From here on no partner's prefix is shortened by its size; at 100 percent all prefixes are of one element.
        if percent == 100 or (low - -(-percent * low // 100) + 1 >= SHARED and prefix_length(low, percent) < low):
            return out


def heavy_hashes(docs: DataFrame, n: int, bound: int = HEAVY) -> np.ndarray:
    """At most ``bound`` hashes that many sets hold, sorted; equal sets of one batch count once."""

    def make():
        shingles = hasher(n)

        def step(batch):
            sets = {x.tobytes(): x for x in (shingles(t) for t in batch.column(0).to_pylist())}
            u, c = np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]), return_counts=True)
            keep = c >= BATCH_MIN
            return {"h": u[keep].view(np.int64), "c": c[keep]}

        return step

    counts = map_batches(docs.select("text"), "h long, c long", make, rows=BATCH_ROWS).groupBy("h").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "h").limit(bound).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def ordered(x: np.ndarray, often: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` elements of the sorted set x in the order of all sets: frequent ones last."""
    if not len(often):
        return x[:count]
    late = often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x
    first = x[~late][:count]
    return first if len(first) == count else np.concatenate([first, x[late][: count - len(first)]])


def sketch(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """A row per row of docs: doc_id, row_key, size, sid (its set), gid (its group: size and prefix), prefix (hashes),
    prints (the size, and 16-bit fingerprints of the prefix)."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_hashes(docs, n))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        shingles, often = hasher(n), heavy.value

        def step(batch):
            sizes, sids, gids, prefixes, prints = [], [], [], [], []
            for t in batch.column(2).to_pylist():
                x = shingles(t)
                first = ordered(x, often, prefix_length(len(x), percent))
                sizes.append(len(x))
                sids.append(xxhash.xxh3_64_intdigest(x.tobytes(), seed=len(x)))
                gids.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=len(x)))
                prefixes.append(first.view(np.int64))
                prints.append(np.int64(len(x)).tobytes() + (first >> np.uint64(20)).astype(np.uint16).tobytes())
            as_long = lambda v: np.array(v, np.uint64).view(np.int64)
            return {"doc_id": batch.column(0), "row_key": batch.column(1), "size": sizes, "sid": as_long(sids), "gid": as_long(gids), "prefix": prefixes, "prints": prints}

        return step

    slim = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    return map_batches(slim, f"doc_id {kind}, row_key long, size long, sid long, gid long, prefix array<long>, prints binary", make)


def _pair_filter(pairs: DataFrame, test: Callable[[np.ndarray, np.ndarray], bool], dtype: type) -> DataFrame:
    """Of pairs (a, b, x, y) those whose arrays x and y, as bytes, pass a test: a, b."""

    def make():
        def step(batch):
            keep = [test(np.frombuffer(x.as_buffer(), dtype), np.frombuffer(y.as_buffer(), dtype)) for x, y in zip(batch.column(2), batch.column(3))]
            rows = batch.filter(pa.array(keep, pa.bool_()))
            return {"a": rows.column(0), "b": rows.column(1)}

        return step

    return map_batches(pairs.select("a", "b", "x", "y"), "a long, b long", make)


def _with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return pairs.join(table.select(F.col("sid").alias("a"), F.col(column).alias("x")), "a").join(table.select(F.col("sid").alias("b"), F.col(column).alias("y")), "b")


def plausible(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members that may link, by the prints of their prefixes (the set's size is put before them)."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        (n, m), (x, y) = (int(x[:4].view(np.int64)[0]), int(y[:4].view(np.int64)[0])), (x[4:], y[4:])
        least = shared(n, len(x), m, len(y), percent)
        # A print that several elements share counts for each of them: never less than what the prefixes share.
        return np.isin(x, y).sum() >= least and np.isin(y, x).sum() >= least

    return _pair_filter(_with_both(pairs, members, "prints"), test, np.uint16)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of members those that link; sets: sid, hs (its hashes as bytes, sorted)."""

    def test(x: np.ndarray, y: np.ndarray) -> bool:
        same = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * same >= percent * (len(x) + len(y) - same)

    return _pair_filter(_with_both(pairs, sets, "hs"), test, np.uint64)


def member_sets(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """sid, hs of the members in chosen (sid, row_key): read again from one document of each."""

    def make():
        shingles = hasher(n)
        return lambda batch: {"sid": batch.column(0), "hs": [shingles(t).tobytes() for t in batch.column(1).to_pylist()]}

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    texts = keyed.join(F.broadcast(chosen) if is_small(chosen, KEYS) else chosen, "row_key")
    return map_batches(texts.select("sid", "text"), T.StructType([T.StructField("sid", T.LongType()), T.StructField("hs", T.BinaryType())]), make).dropDuplicates(["sid"])


def classes(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """A row per row of docs: doc_id, row_key (hash of doc_id and text), n_shingles, component_id, n_links.

    Words are runs of characters other than ASCII white space, A-Z lowered; a set holds distinct shingles of n words (a
    shorter text is one shingle, an empty or null text has none and links with nothing). Two documents link when
    100 * intersection >= percent * union. component_id is the least doc_id reachable, its own included (nulls last);
    n_links counts the verified links of its set in the spanning search, not all pairs. Extra columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    made = cut(sketch(docs, n, percent))
    full = made.where("size > 0")
    members = cut(full.groupBy("sid", "size").agg(F.min("row_key").alias("row_key"), F.first("gid").alias("gid"), F.first("prints").alias("prints")))
    post = full.groupBy("gid", "size").agg(F.first("prefix").alias("prefix"))
    table = least_shared(percent)
    least = F.get(F.lit(table), F.least(F.col("size"), F.lit(len(table) - 1)).cast("int"))
    post = post.select("gid", F.col("size").cast("int").alias("size"), least.alias("least"), F.explode("prefix").alias("h"))
    # Lists of one group are dropped before any join; the counts are summed before the shuffle.
    lists = post.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    met = cut(post.join(lists, "h"))
    # Of its shared elements any least - 1 may be left out: a partner is still met by another. The most frequent ones are.
    group = W.partitionBy("gid")
    post = met.withColumn("held", F.count("*").over(group)).where("held >= least").withColumn("rank", F.row_number().over(group.orderBy("c", "h"))).where("rank <= held - least + 2")
    # Geometric size bands: partners are in the same band or the next.
    band = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / min(percent, 99)) + 1e-9).cast("int")
    # One element more than is needed to meet is kept, for the lists that are split.
    every = cut(post.select("h", band.alias("band"), "gid", "held", "rank", "least"))
    drop(met)
    post = every.where("rank <= held - least + 1")
    crowds = members.groupBy("gid").agg(F.count("*").alias("c")).where("c > 1").select("gid")
    # Postings without a second one in their band or a neighbouring one can meet nothing.
    near = post.groupBy("h", "band").agg(F.count("*").alias("c"))
    near = near.select("h", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), "c").groupBy("h", "band").agg(F.sum("c").alias("c")).where("c > 1").select("h", "band")
    post = cut(post.join(near, ["h", "band"]))
    held = post.select("gid", "held").unionByName(crowds.select("gid", F.lit(0).cast("long").alias("held"))).groupBy("gid").agg(F.max("held").alias("held"))
    active = cut(members.select("sid", "size", "gid").join(held, "gid"))
    n_active = active.count()
    crowds = cut(crowds)
    post = post.select("h", "band", "gid", "rank", (F.col("held") - F.col("least")).alias("spare"), "least")

    first = lambda n: n - F.ceil(n * percent / 100).cast("long") + 1
    length = lambda n: F.least(n, first(n) - 1 + F.least(F.lit(SHARED).cast("long"), first(n)))
    x, y = F.col("size"), F.col("size2")
    same = F.ceil((x + y) * percent / (100 + percent)).cast("long")
    #: As shared() has it, of (size) and (size2).
    both_hold = F.least(length(x) - x + same, length(y) - y + same)
    fits = (x * 100 >= y * percent) & (y * 100 >= x * percent)
    # Neither has too few elements that others hold; what a group holds as a whole, its members share.
    may_link = fits & ((F.col("gid") == F.col("gid2")) | (F.least("held", "held2") >= both_hold))
    # The first element that a pair shares comes early enough, on either side, for the others to follow.
    early = (F.col("rank") <= F.col("held") - both_hold + 1) & (F.col("rank2") <= F.col("held2") - both_hold + 1)

    second = lambda df: df.select(*[F.col(c).alias(f"{c}2") for c in df.columns])
    label = edges = None  # node and label of members in components of more than one; a and b of links
    owned = active.withColumn("comp", F.col("sid"))

    def take(pairs: DataFrame) -> int:
        """Verifies pairs (sid, sid2), joins what links; the number of new links."""
        nonlocal edges, label, owned
        pairs = pairs.select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
        pairs = cut(plausible(pairs, members, percent))
        chosen = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct().join(members.select("sid", "row_key"), "sid")
        sets = cut(member_sets(docs, chosen, n))
        new = cut(verified(pairs, sets, percent))
        drop(sets)
        drop(pairs)
        found = new.count()
        if found:
            before = owned if label is not None else None  # the first one reads the table of all active members
            edges = new if edges is None else edges.unionByName(new)
            label = components(edges)
            owned = cut(active.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("label", "sid")).drop("label"))
            if before is not None:
                drop(before)
        return found

    left = None
    for rank in range(ROUNDS):
        # A star for each list and band, and one within each crowded group; hubs change from round to round.
        heads = owned.groupBy("gid").agg(F.min_by(F.struct("sid", "comp", "size", "held"), F.xxhash64("sid", F.lit(rank))).alias("h")).select("gid", "h.*")
        # The first hubs are those with the most elements that others hold: what the others were copied from.
        spread = F.struct((-F.col("held") if rank == 0 else F.lit(0)).alias("held"), F.xxhash64("gid", F.lit(rank)).alias("rank"))
        hubs = post.join(heads.select("gid", "held"), "gid").groupBy("h", "band").agg(F.min_by("gid", spread).alias("gid2"))
        stars = post.join(hubs, ["h", "band"]).select("gid", "gid2").unionByName(crowds.select("gid", F.col("gid").alias("gid2"))).distinct()
        pairs = stars.join(second(heads), "gid2").join(owned, "gid").where((F.col("comp") != F.col("comp2")) & may_link)
        found = take(pairs)
        # What is left to compare: members of different components in one list, or in one group.
        parts = owned.groupBy("gid", "comp").agg(F.count("*").alias("m"))
        if left is not None:
            drop(left)
            drop(inside)
        left = post.join(parts, "gid")
        mixed = left.groupBy("h").agg(F.min("comp").alias("l"), F.max("comp").alias("r")).where("l <> r").select("h")
        left = cut(left.join(mixed, "h"))
        inside = cut(parts.join(crowds, "gid"))
        by_comp = left.groupBy("h", "band", "comp").agg(F.sum("m").alias("m"))
        # How many pairs that would be is known before any is made.
        square = F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))
        n_pairs = sum(x.groupBy(*k).agg(square.alias("p")).agg(F.sum("p")).first()[0] or 0 for x, k in ((by_comp, ("h", "band")), (inside, ("gid",)))) // 2
        if n_pairs <= CROSS * n_active or found < USEFUL * n_active:
            break
    # A crowded list's members go by their first and second shared element; sets whose partners may share one alone stay too.
    crowded = cut(left.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > CROWDED).select("h"))
    if not crowded.isEmpty():
        columns = ("h", "band", "gid", "rank", "comp", "m")
        many = cut(left.join(crowded, "h"))
        later = every.select("gid", F.col("h").alias("h2"), F.col("rank").alias("rank2"))
        pair = many.join(later, "gid").where("rank2 > rank AND rank2 <= spare + 2")
        pair = cut(pair.select(F.xxhash64("h", "h2").alias("h"), "band", "gid", (F.col("rank2") - 1).alias("rank"), "comp", "m"))
        mixed = pair.groupBy("h").agg(F.min("comp").alias("l"), F.max("comp").alias("r")).where("l <> r").select("h")
        whole = left.join(crowded, "h", "left_anti").select(*columns).unionByName(many.where("least = 1").select(*columns))
        left = cut(whole.unionByName(spread_join(pair, mixed, ["h"]).select(*columns)))
        drop(pair)
        drop(many)
        by_comp = left.groupBy("h", "band", "comp").agg(F.sum("m").alias("m"))
    # Two components of few members in a list are set against each other as they are; a large one is first paired with the
    # list's other components, so that members of one component are never compared.
    about = owned.groupBy("gid", "comp").agg(F.first("size").alias("size"), F.first("held").alias("held"))
    rows = left.select("h", "band", "gid", "comp", "rank").join(about, ["gid", "comp"])
    rows = cut(rows.join(by_comp.select("h", "band", "comp", (F.col("m") > FEW).alias("large")), ["h", "band", "comp"]))
    other = second(rows).withColumnRenamed("h2", "h")
    apart = (F.col("comp") != F.col("comp2")) & (F.col("gid") != F.col("gid2")) & fits & early
    forward = (F.col("band") != F.col("band2")) | (F.col("gid") < F.col("gid2"))
    few = rows.where("not large").withColumn("band2", F.explode(F.array("band", F.col("band") + 1))).join(other.where("not large2"), ["h", "band2"]).where(forward & apart)
    comps = rows.groupBy("h", "band", "comp").agg(F.first("large").alias("large"))
    facing = comps.where("large").withColumn("band2", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1))).join(second(comps).withColumnRenamed("h2", "h"), ["h", "band2"]).where((F.col("comp") != F.col("comp2")) & (~F.col("large2") | (F.col("comp") < F.col("comp2"))))
    # The other components' members come first: only the last join meets those of the large one, with all conditions.
    many = facing.select("h", "band", "comp", "band2", "comp2").join(other, ["h", "band2", "comp2"]).join(rows, ["h", "band", "comp"]).where(apart)
    within = inside.select("gid", "comp").join(inside.select("gid", F.col("gid").alias("gid2"), F.col("comp").alias("comp2")), "gid").where("comp < comp2")
    both = few.select("gid", "comp", "gid2", "comp2").unionByName(many.select("gid", "comp", "gid2", "comp2")).unionByName(within.select("gid", "comp", "gid2", "comp2")).distinct()
    each = owned.select("gid", "comp", "sid", "size", "held")
    take(both.join(each, ["gid", "comp"]).join(second(each), ["gid2", "comp2"]).where(may_link))

    # A component's name is the least doc_id of all documents with one of its sets.
    least = full.groupBy("sid").agg(F.min("doc_id").alias("least"))
    if edges is None:
        named = least.select("sid", F.col("least").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    else:
        known = least.join(label.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
        links = edges.select(F.col("a").alias("sid")).unionByName(edges.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n_links"))
        named = spread_join(known, known.groupBy("label").agg(F.min("least").alias("component_id")), ["label"]).join(links, "sid", "left").select("sid", "component_id", "n_links")
    out = made.select("doc_id", "row_key", "size", "sid").join(named, "sid", "left")
    return out.select("doc_id", "row_key", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def drop_near(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component left, that of the least doc_id; texts without words all stay, once each.

    Rows repeated exactly (same doc_id and text) count as one; of those that differ in other columns the one with the least
    hash of all columns stays. Of rows with one doc_id and several texts in a component the one with the least row key stays.
    Null ids come last. All columns pass unchanged, whatever their names.
    """
    found = classes(docs, n, percent)
    # A component is told by its least doc_id; null doc_ids are told by their own key.
    name = F.struct(F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("c"), F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("row_key")).alias("k"))
    keep = found.groupBy(name.alias("name")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")).alias("least")).select("least.row_key")
    (key,) = fresh(docs, "row_key")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(keep.withColumnRenamed("row_key", key), key, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    told = [c for c, f in zip(columns, docs.schema) if "map<" not in f.dataType.simpleString()]
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), F.xxhash64(*told)).alias("row")).select("row.*")
