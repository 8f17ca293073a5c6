"""Token counts by a map-side two-tier lookup.

Tier 1 is a broadcast table of the lengths of frequent pre-tokens. They are counted over all documents first: each task
keeps its own counts, thinned to the most frequent ones whenever they outgrow a bound, and gives no more than PER_TASK of
them, whose sums name the TABLE most frequent. The bounds touch nothing but speed: any table gives the same result. Tier 2
is a cache that lives as long as the Python worker, over tasks and batches; only pre-tokens that neither tier knows are
encoded. No pre-token of a document is ever shuffled, only the tasks' bounded counts.

Pre-tokens: the tokenizer writes a space as U+2581, puts one before the text, and no piece of its vocabulary holds that
mark after another character (checked when the table is built). So no merge crosses the place before a run of marks, and
a text's count is the sum over its pieces "run of marks, run of other characters". Where a vocabulary breaks that rule,
whole texts are encoded instead.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROWS, map_batches, slices

MARK = "▁"
PIECES = re.compile("[ ▁]+[^ ▁]*")
LIMIT = 4096
#: Entries of the table; of a task's counts, as they go on and while they are made.
TABLE, PER_TASK, HELD = 32_768, 4096, 1 << 17
#: Entries a worker's cache may hold before it starts afresh: about 50 MB of short words.
CACHE = 250_000
#: Longer pre-tokens are encoded each time and not kept.
LONGEST = 64


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def worker(path: str) -> tuple:
    """The tokenizer and the second tier (pre-token to length), once for a Python process."""
    return load(path), {}


def pre_tokens(text: str) -> list[str]:
    return PIECES.findall(" " + text) if text else []


def lengths(sp, pieces: list[str]) -> dict[str, int]:
    # The library puts a mark of its own before what it encodes; it stands for the piece's first one.
    alone = len(sp.encode("a ")) - len(sp.encode("a"))
    return {p: len(ids) if len(p) > 1 else alone for p, ids in zip(pieces, sp.encode([p[1:] for p in pieces], num_threads=1))}


def frequent(path: str, pieces: list[str] | None = None) -> dict[str, int] | None:
    """The lengths of pre-tokens (with their space), by default of the vocabulary's word pieces; None if a vocabulary's
    pre-tokens can't be taken alone."""
    sp = load(path)
    known = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in known) or len(sp.encode("a b")) != len(sp.encode("a")) + len(sp.encode("b")) or len(sp.encode("  a")) < 2:
        return None
    return lengths(sp, [" " + p[1:] for p in known if re.fullmatch(f"{MARK}[^{MARK}]+", p)] if pieces is None else pieces)


def most_frequent(docs: DataFrame, text: str = "text", bound: int = TABLE) -> list[str]:
    """At most ``bound`` pre-tokens that are frequent in all of docs, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in (p for b in batches for p in slices(b, ROWS)):
            for t in part.column(0):
                seen.update(p for p in pre_tokens(t.as_py() or "") if len(p) <= LONGEST)
                if len(seen) > HELD:
                    seen = Counter(dict(seen.most_common(HELD // 4)))
        top = seen.most_common(PER_TASK)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["piece", "n"])

    counts = docs.select(text).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in counts.orderBy(F.desc("n"), "piece").limit(bound).collect()]


def counter(path: str, table: dict[str, int] | None):
    """A function from a list of texts to their token counts; table: the first tier, or None for whole texts."""
    sp, cache = worker(path)
    if table is None:
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]

    def one(text: str) -> int:
        pieces = pre_tokens(text)
        found = list(map(table.get, pieces))
        n = sum(filter(None, found))
        if None in found:
            missed = [p for p, k in zip(pieces, found) if k is None]
            new = [p for p in set(missed) if p not in cache]
            if new:
                cache.update(lengths(sp, new))
            n += sum(map(cache.__getitem__, missed))
            for p in new:
                if len(p) > LONGEST:
                    del cache[p]
            if len(cache) > CACHE:
                cache.clear()
        return n

    return lambda texts: list(map(one, texts))


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with a column ``out``: tokens of ``text``; a null or empty text has none. Other columns pass unchanged.

    Two narrow passes: the counts of frequent pre-tokens, then the lookup; rows stay where they are. Long texts only cost
    their own length; a column already named ``out`` is replaced. Equal texts have equal counts.
    """
    spark = docs.sparkSession
    alone = frequent(model_path, []) is not None
    table = spark.sparkContext.broadcast(frequent(model_path, most_frequent(docs, text)) if alone else None)
    docs = docs.drop(out) if out in docs.columns else docs
    schema = T.StructType([*docs.schema, T.StructField(out, T.LongType())])
    names = docs.columns

    def make():
        count = counter(model_path, table.value)

        def step(batch):
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            return {n: batch.column(i) for i, n in enumerate(names)} | {out: count(texts)}

        return step

    return map_batches(docs, schema, make)


def token_report(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit. A null text counts as empty: no bytes, no tokens.

    Repeated rows and ids are counted each; other columns are ignored."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return count_tokens(slim, model_path).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
