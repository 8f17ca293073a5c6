"""Quality classifier from weak labels.

Heuristic labellers vote bad (0), good (1) or abstain (2) on every document. Votes overlap and disagree; expectation
maximisation (a latent class model: good documents, and bad ones of one or several kinds, votes independent within a class)
estimates each labeller's confusion from the counts of vote patterns over all documents, of which there are 3^labellers at
most, and gives every pattern a posterior. These posteriors are the labels on which a hashed linear scorer is trained, on a
bounded sample; the scorer then judges every document from its own features, votes not among them. A second head of the same
scorer is trained on a bounded sample of the table's toxic labels, where there is one. A document is kept if its quality
score is at least 0.5 and its toxic score is under 0.5.

Documents without words are scored like any other. A null text counts as empty. Samples are drawn by a hash of id and text
over all rows, null ids among them; rows repeated exactly are drawn once, so a fit is repeatable whatever the partitions.
Of several labels of one id, one that says toxic holds; labels without an id, and empty tables, are no error.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, map_batches

GOOD, BAD, ABSTAIN = 1, 0, 2
LABELLERS = ("shouting", "symbols", "repeats", "tables", "exclaims", "variety", "sentences")
#: Bounds, parameters of fit() but for the last: documents for the quality head, documents of each class for the toxic head,
#: features kept of each head.
TRAIN_ROWS, TOXIC_ROWS, FEATURES = 4000, 2000, 512
#: Files of the samples, which are bounded, and of their counts.
FILES = 12
#: Hash space of the features, as bits.
BITS = 22
#: A feature is kept if so many sampled documents have it at least, and it differs by class by so many standard deviations.
LEAST, Z = 6, 4.0
#: Sampled texts whose features a worker holds at once; a unit of their targets.
SAMPLE_ROWS, ONE = 64, 1 << 30

#: Entries of each of a worker's caches before it starts afresh.
CACHE = 200_000

LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
SYMBOLS = frozenset(b"#$%&*|@^~=<>{}[]\\_+")
DROP_SYMBOLS = bytes(SYMBOLS)
UPPERS, LOWERS = bytes(range(65, 91)), bytes(range(97, 123))
ENDS = (b".", b"!", b"?", b'."', b".)", b":")


def measures(raw: bytes, words: list[bytes]) -> dict[str, float]:
    """Rates of one text's signs of trouble (its bytes and its words); of an empty text all are 0."""
    n, size = max(1, len(words)), max(1, len(raw))
    upper, lower = size - len(raw.translate(None, UPPERS)), size - len(raw.translate(None, LOWERS))
    lines = [x.rstrip() for x in raw.split(b"\n") if x.strip()]
    return {
        "words": len(words),
        "upper": upper / max(1, upper + lower) if raw else 0.0,
        "letters": upper + lower,
        "symbols": (len(raw) - len(raw.translate(None, DROP_SYMBOLS))) / size,
        "repeats": sum(map(eq, words, islice(words, 1, None))) / n,
        "bars": words.count(b"|") / n,
        "exclaims": raw.count(b"!!") / n,
        "variety": len(set(words)) / n,
        "ended": sum(x.endswith(ENDS) for x in lines) / max(1, len(lines)),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """One vote of each of LABELLERS."""
    between = lambda x, good, bad: GOOD if x <= good else BAD if x >= bad else ABSTAIN
    long = m["words"] >= 20
    return (
        between(m["upper"], 0.15, 0.3) if m["letters"] >= 20 else ABSTAIN,
        between(m["symbols"], 0.005, 0.03) if m["words"] >= 5 else ABSTAIN,
        between(m["repeats"], 0.03, 0.1) if m["words"] >= 5 else ABSTAIN,
        between(m["bars"], 0.002, 0.05) if m["words"] >= 5 else ABSTAIN,
        between(m["exclaims"], 0.005, 0.05) if m["words"] >= 5 else ABSTAIN,
        (BAD if m["variety"] < 0.35 else GOOD if m["words"] <= 400 and m["variety"] > 0.6 else ABSTAIN) if long else ABSTAIN,
        (GOOD if m["ended"] >= 0.9 else BAD if m["ended"] < 0.3 and long else ABSTAIN) if m["words"] else ABSTAIN,
    )


def expect(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, smooth: np.ndarray, rounds: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """EM from posteriors ``start`` (class, pattern): log-likelihood, posteriors, priors, confusion[class, labeller, vote].

    A labeller that abstains says nothing, so abstentions count neither way. ``smooth`` are votes counted beforehand.
    """
    hot = np.stack([patterns == v for v in (BAD, GOOD)], axis=-1).astype(float)
    posterior, known = start, np.zeros(len(counts))
    priors = confusion = np.empty(0)
    for _ in range(rounds):
        weight = posterior * counts
        priors = weight.sum(axis=1) + 1
        priors /= priors.sum()
        confusion = np.einsum("ki,ilv->klv", weight, hot) + smooth
        confusion /= confusion.sum(axis=2, keepdims=True)
        score = np.einsum("klv,ilv->ki", np.log(confusion), hot) + np.log(priors)[:, None]
        top = score.max(axis=0)
        known = top + np.log(np.exp(score - top).sum(axis=0))
        after = np.exp(score - known)
        settled = np.abs(after - posterior).max() < 1e-9
        posterior = after
        if settled:
            break
    return float((known * counts).sum()), posterior, priors, confusion


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows) and their counts: posterior of good for each, priors, confusion[class, labeller, vote].

    Class 0 is good, the others are bad: one class for each labeller's kind of trouble. Two models are fitted. In the first
    bad documents are all alike (their classes share one confusion). In the second each kind has a confusion of its own, as
    documents may go wrong in ways that exclude each other. Either starts once from the share of good votes and once from
    the complaints (one complaint outweighs the many signs that only fail to complain); of the four fits the one with the
    best Bayesian information criterion stays, so kinds are told apart only where the votes bear it out.
    """
    labellers = patterns.shape[1]
    bad = (patterns == BAD).astype(float)
    n_bad, n_good = bad.sum(axis=1), (patterns == GOOD).sum(axis=1)
    share = np.where(n_bad[:, None] > 0, bad / np.maximum(n_bad, 1)[:, None], 1 / labellers).T
    two, kinds = np.ones((2, labellers, 2)), np.ones((labellers + 1, labellers, 2))
    two[0, :, GOOD] = two[1, :, BAD] = 4
    kinds[0, :, GOOD] = 20 + 0.02 * counts.sum()  # a complaint about a good document is rare
    kinds[1 + np.arange(labellers), np.arange(labellers), BAD] = 20
    best = None
    for start in ((n_good + 0.5) / (n_good + n_bad + 1), np.where(n_bad > 0, 0.1, np.where(n_good > 0, 0.95, 0.5))):
        for first, smooth in ((np.stack([start, 1 - start]), two), (np.concatenate([start[None], (1 - start) * share]), kinds)):
            value, posterior, priors, confusion = expect(patterns, counts, first, smooth, rounds)
            value -= np.log(max(2.0, counts.sum())) / 2 * (len(priors) * (labellers + 1) - 1)
            if best is None or value > best[0]:
                best = value, posterior[0], priors, confusion
    _, posterior, priors, confusion = best
    if len(priors) == 2:  # the same model, written as classes that don't differ
        priors = np.r_[priors[0], np.full(labellers, priors[1] / labellers)]
        confusion = np.concatenate([confusion[:1], np.repeat(confusion[1:], labellers, axis=0)])
    return posterior, priors, confusion


class Hasher:
    """Binary hashed features of a text: its words, the shapes of its words by share, and steps of its rates."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}
        self.shapes: dict[bytes, bytes] = {}

    def hashed(self, key: bytes) -> int:
        got = self.cache.get(key)
        if got is None:
            if len(self.cache) > CACHE:
                self.cache.clear()
            got = self.cache[key] = xxhash.xxh3_64_intdigest(key) & ((1 << BITS) - 1)
        return got

    def tail(self, word: bytes) -> bytes:
        """A word's closing signs, or whether it is all capitals."""
        got = self.shapes.get(word)
        if got is None:
            if len(self.shapes) > CACHE:
                self.shapes.clear()
            body = word.rstrip(b".,;:!?#$%&*|@^~=<>{}[]\\_+\"')(")
            got = self.shapes[word] = (b"A" if len(body) > 1 and body.isupper() else b"a") + word[len(body) :][:4]
        return got

    def __call__(self, raw: bytes, words: list[bytes], m: dict[str, float]) -> np.ndarray:
        known, hashed = self.cache.get, self.hashed
        keys = set()
        for w in set(raw.lower().translate(LETTERS).split()):
            got = known(w)
            keys.add(hashed(w) if got is None else got)
        n = max(1, m["words"])
        shapes: dict[bytes, int] = {}
        for w, count in Counter(words).items():
            shape = self.shapes.get(w) or self.tail(w)
            shapes[shape] = shapes.get(shape, 0) + count
        for shape, count in shapes.items():
            for i, share in enumerate((0.01, 0.05, 0.2)):
                if count / n >= share:
                    keys.add(hashed(b"\x00shape%d" % i + shape))
        for name in ("upper", "symbols", "repeats", "bars", "exclaims", "variety", "ended"):
            for i, step in enumerate((0.002, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)):
                if m[name] >= step:
                    keys.add(hashed(f"\x00{name}{i}".encode()))
        return np.fromiter(sorted(keys), np.int32, len(keys))


def code(m: dict[str, float]) -> int:
    """A vote pattern as a number to base 3."""
    return sum(v * 3**i for i, v in enumerate(votes(m)))


def look(hashed: Hasher, text: str | None) -> tuple[int, np.ndarray]:
    """A text's vote pattern and features."""
    raw = (text or "").encode()
    words = raw.split()
    m = measures(raw, words)
    return code(m), hashed(raw, words, m)


def train(rows: list[np.ndarray], target: np.ndarray, l2: float = 0.5, rounds: int = 40, least: int = LEAST, z: float = Z) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature, weight, bias) of a logistic scorer on soft targets; of the features only those that clearly differ by class."""
    n = len(rows)
    if n == 0:
        return np.empty(0, np.int32), np.empty(0), 0.0
    flat, which = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    ids, inverse = np.unique(flat, return_inverse=True)
    total, hit = np.bincount(inverse, minlength=len(ids)), np.bincount(inverse, target[which], minlength=len(ids))
    rate = target.mean()
    spread = (hit - total * rate) / np.sqrt(np.maximum(total * rate * (1 - rate), 1e-9))
    good = np.flatnonzero((total >= least) & (np.abs(spread) >= z))
    good = np.sort(good[np.argsort(-np.abs(spread[good]), kind="stable")[:FEATURES]])
    if not len(good):  # nothing tells the classes apart: every document has the sample's rate
        return ids[:0], np.empty(0), math.log((rate + 1e-6) / (1 - rate + 1e-6))
    column = np.full(len(ids), -1)
    column[good] = np.arange(len(good))
    at = column[inverse]
    x = np.ones((n, len(good) + 1))
    x[:, :-1] = 0
    x[which[at >= 0], at[at >= 0]] = 1
    # Newton steps on the penalised likelihood; a rare class weighs as much as a common one.
    weight = np.where(target >= 0.5, 0.5 / max(rate, 1e-3), 0.5 / max(1 - rate, 1e-3))
    beta, ridge = np.zeros(len(good) + 1), np.r_[np.full(len(good), l2), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ ((target - p) * weight) - ridge * beta
        step = np.linalg.solve((x * (p * (1 - p) * weight)[:, None]).T @ x + np.diag(ridge), slope)
        beta += step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-6:
            break
    w, b = beta[:-1], beta[-1]
    return ids[good], w, float(b)


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    ids, w, b = model

    def score(features: np.ndarray) -> float:
        if not len(ids):
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, b))))
        at = np.minimum(np.searchsorted(ids, features), len(ids) - 1)
        s = b + w[at[ids[at] == features]].sum()
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))

    return score


def vote_patterns(docs: DataFrame) -> DataFrame:
    """pattern (its votes as a number to base 3), n: counts over all documents."""

    def make():
        def step(batch):
            seen = Counter(code(measures(raw, raw.split())) for raw in ((t or "").encode() for t in batch.column(0).to_pylist()))
            return {"pattern": list(seen), "n": list(seen.values())}

        return step

    return map_batches(docs.select("text"), "pattern int, n long", make).groupBy("pattern").agg(F.sum("n").alias("n"))


def telling(docs: DataFrame, by: dict[int, float] | None) -> np.ndarray:
    """The features that train() may keep of docs, FEATURES at most, sorted; counted by the executors, for texts of any length.

    Targets are the posteriors ``by`` pattern, or the column target.
    """

    def make():
        hashed = Hasher()

        def step(batch):
            seen = [look(hashed, t) for t in batch.column(0).to_pylist()]
            goal = [by.get(p, 0.5) for p, _ in seen] if by is not None else batch.column(1).to_pylist()
            goal = np.array([round(g * ONE) for g in goal], np.int64)
            ids, inverse = np.unique(np.concatenate([f for _, f in seen] or [np.empty(0, np.int32)]), return_inverse=True)
            hit = np.zeros(len(ids), np.int64)
            np.add.at(hit, inverse, np.repeat(goal, [len(f) for _, f in seen]))
            # Feature -1 is that of all documents.
            return {"feature": np.r_[ids, -1], "total": np.r_[np.bincount(inverse, minlength=len(ids)), len(seen)], "hit": np.r_[hit, goal.sum()]}

        return step

    counts = map_batches(docs.select("text", "target"), "feature int, total long, hit long", make, rows=SAMPLE_ROWS).groupBy("feature").agg(F.sum("total").alias("total"), F.sum("hit").alias("hit"))
    counts = cut(counts.where((F.col("total") >= LEAST) | (F.col("feature") == -1)).coalesce(FILES))
    whole = counts.where("feature = -1").first()
    if whole is None or not whole.total:
        return np.empty(0, np.int32)
    rate = whole.hit / ONE / whole.total
    spread = F.abs(F.col("hit") / ONE - F.col("total") * rate) / F.sqrt(F.greatest(F.col("total") * rate * (1 - rate), F.lit(1e-9)))
    best = counts.where("feature >= 0").select("feature", spread.alias("spread")).where(F.col("spread") >= Z * (1 - 1e-9)).orderBy(F.desc("spread"), "feature").limit(FEATURES)
    return np.sort(np.array([r.feature for r in best.collect()], np.int32))


def least(docs: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` rows of docs (key, text, target) with the least keys; of equal keys one row counts."""
    docs = cut(docs.select("key", "text", "target").dropDuplicates(["key"]).coalesce(FILES))
    return docs.join(F.broadcast(docs.select("key").orderBy("key").limit(bound)), "key", "left_semi")


def featured(docs: DataFrame, by: dict[int, float] | None = None) -> list:
    """pattern, the telling() ones of the features, and target of the rows of docs (text, target), whose number the caller bounds."""
    docs = docs.select("text", F.col("target").cast("int").alias("target"))
    kept = telling(docs, by)

    def make():
        hashed = Hasher()

        def step(batch):
            seen = [look(hashed, t) for t in batch.column(0).to_pylist()]
            return {"pattern": [p for p, _ in seen], "features": [f[np.isin(f, kept)] for _, f in seen], "target": batch.column(1)}

        return step

    found = map_batches(docs, "pattern int, features array<int>, target int", make, rows=SAMPLE_ROWS).collect()
    return sorted(found, key=lambda r: (r.pattern, r.target, r.features))


def below(key: str, bound: int, of: int):
    """Whether a hash is among the lowest, of so many that twice ``bound`` are expected; a narrow way to a sample."""
    share = min(1.0, 2 * bound / max(1, of))
    return F.lit(True) if share == 1 else F.col(key) < F.lit(int(share * 2**64) - 2**63)


def fit(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, toxic_rows: int = TOXIC_ROWS) -> dict:
    """The model: posteriors by vote pattern, labellers' confusions, and the heads (feature, weight, bias)."""
    known = sorted((r.pattern, r.n) for r in vote_patterns(docs).collect())  # at most 3 ** labellers rows
    codes = np.array([p for p, _ in known], int).reshape(-1)
    patterns = (codes[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    posterior, priors, confusion = fit_labellers(patterns, np.array([n for _, n in known], float)) if known else (np.empty(0), np.array([0.5]), np.empty(0))
    by = dict(zip(codes.tolist(), posterior.tolist()))
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = featured(least(keyed.where(below("key", train_rows, sum(n for _, n in known))).withColumn("target", F.lit(0)), train_rows), by)
    quality = train([np.array(r.features, np.int32) for r in rows], np.array([by.get(r.pattern, 0.5) for r in rows]))
    toxic = (np.empty(0, np.int32), np.empty(0), -30.0)
    if labels is not None:
        each = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("target")).withColumn("drawn", F.xxhash64("doc_id"))
        sizes = {r.target: r["count"] for r in each.groupBy("target").count().collect()}  # two rows
        parts = [each.where((F.col("target") == k) & below("drawn", toxic_rows, sizes.get(k, 0))).orderBy("drawn", "doc_id").limit(toxic_rows) for k in (0, 1)]
        asked = parts[0].unionByName(parts[1]).select("doc_id", "target")
        rows = featured(least(keyed.join(F.broadcast(asked), "doc_id"), 2 * toxic_rows))
        if {r.target for r in rows} == {0, 1}:
            toxic = train([np.array(r.features, np.int32) for r in rows], np.array([float(r.target) for r in rows]))
    return {"posterior": by, "prior": float(priors[0]), "confusion": confusion, "quality": quality, "toxic": toxic}


ADDED = ("weak_label", "quality", "toxic", "keep")


def classify(docs: DataFrame, model: dict, names: tuple[str, str, str, str] = ADDED) -> DataFrame:
    """docs with the posterior of a row's votes, its quality and toxic scores (0 to 1) and whether it is kept, under ``names``.

    Columns of these names are replaced, all others pass unchanged. Every row gets its scores, repeated ones the same. A
    narrow step.
    """
    added = T.StructType([T.StructField(n, T.BooleanType() if n == names[3] else T.DoubleType()) for n in names])
    docs = docs.drop(*names)
    columns = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value
        hashed, quality, toxic = Hasher(), scorer(m["quality"]), scorer(m["toxic"])

        def step(batch):
            rows = []
            for t in batch.column(columns.index("text")).to_pylist():
                pattern, f = look(hashed, t)
                q, x = quality(f), toxic(f)
                rows.append((m["posterior"].get(pattern, m["prior"]), q, x, q >= 0.5 and x < 0.5))
            return {n: batch.column(i) for i, n in enumerate(columns)} | dict(zip(names, zip(*rows)))

        return step

    return map_batches(docs, T.StructType([*docs.schema, *added]), make)
