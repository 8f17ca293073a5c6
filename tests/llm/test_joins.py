"""The joins over documents against brute force: near copies, benchmark items, repeated bytes; hot groups and odd input."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import components, decontam, near, queries, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row_key", "sid", "gid", "size", "h", "band", "bucket", "window", "count", "comp", "label", "wh", "width", "ranges")


def docs(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({c: F.lit("mine") for c in CLASHES}) if extra else df


def vocabulary(rng, n=400):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 8))) for _ in range(n)]


def edited(rng, words, vocab, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(vocab)
    return words


def corpus(seed=1, n=120):
    """Documents with near copies of many strengths, chains of edits, copies, shared passages and odd texts."""
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    rows, passage = [], [rng.choice(vocab) for _ in range(40)]
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(1, 150))]
        for _ in range(rng.randrange(4)):
            rows.append(" ".join(w))
            w = edited(rng, w, vocab, rng.randrange(4))
        if rng.random() < 0.3:
            rows.append(" ".join(w[: len(w) // 2] + passage + w[len(w) // 2 :]))
    rows += [None, "", " \t\n", "one", "One", "one two", "ONE  two", "é É", "K x y z", "same words here " * 50, "same words here " * 51]
    rng.shuffle(rows)
    return list(enumerate(rows))


def sets(rows, n):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute_components(rows, n, percent):
    s = sets(rows, n)
    parent = list(range(len(s)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(s)):
        for b in range(a):
            if s[a] and s[b]:
                same = len(s[a] & s[b])
                if 100 * same >= percent * (len(s[a]) + len(s[b]) - same):
                    parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (2, 50, 4)])
def test_near_components(spark, n, percent, seed):
    rows = corpus(seed, 60)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.classes(docs(spark, rows), n, percent).orderBy("doc_id").collect()]
    assert got == brute_components(rows, n, percent)


def test_near_when_every_bound_is_small(spark, monkeypatch):
    """Same links with hardly a frequent hash, more rounds of stars, every component large, and joins instead of broadcasts."""
    rows = corpus(7, 40)
    for k, v in {"HEAVY": 1, "CROSS": 0, "USEFUL": 0.0, "ROUNDS": 2, "KEYS": 1, "SHARED": 1, "FEW": 1, "BATCH_MIN": 1}.items():
        monkeypatch.setattr(near, k, v)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.classes(docs(spark, rows), 5, 80).orderBy("doc_id").collect()]
    assert got == brute_components(rows, 5, 80)


@pytest.mark.parametrize(("n", "percent", "shared"), [(3, 90, 16), (2, 50, 2), (5, 80, 1)])
def test_near_when_every_list_is_crowded(spark, monkeypatch, n, percent, shared):
    """Same links when all lists are split by a second element, and when no second one is sure."""
    rows = corpus(11, 40)
    for k, v in {"CROWDED": 1, "SHARED": shared, "ROUNDS": 1, "HEAVY": 1, "FEW": 1}.items():
        monkeypatch.setattr(near, k, v)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.classes(docs(spark, rows), n, percent).orderBy("doc_id").collect()]
    assert got == brute_components(rows, n, percent)


@pytest.mark.parametrize(("n", "percent", "words"), [(3, 90, 12), (5, 80, 9), (3, 90, 22), (5, 80, 14)])
def test_near_smaller_partner(spark, n, percent, words):
    """A text and the same one without its last word link, though the shorter one's prefix is shorter; so do their copies."""
    long = [[f"w{k}x{i}" for i in range(words)] for k in range(12)]
    rows = list(enumerate([" ".join(w[: words - j]) for w in long for j in (0, 1, 1)]))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.classes(docs(spark, rows), n, percent).orderBy("doc_id").collect()]
    assert got == brute_components(rows, n, percent)
    assert len({c for *_, c in got}) == len(long)


def test_least_shared_brute():
    for percent in (50, 66, 80, 90, 99, 100):
        table = near.least_shared(percent)
        for x in range(1, 2 * len(table) + 50):
            sizes = [y for y in range(1, 2 * x + 1) if 100 * min(x, y) >= percent * max(x, y)]
            low = min(near.shared(x, near.prefix_length(x, percent), y, near.prefix_length(y, percent), percent) for y in sizes)
            assert 1 <= table[min(x, len(table) - 1)] == min(near.SHARED, low), (percent, x)


def test_near_hot_group(spark):
    """A third of the rows are one text, another third near copies of one: all in their components, no pairs of copies."""
    rng = random.Random(3)
    vocab = vocabulary(rng)
    base, other = [rng.choice(vocab) for _ in range(120)], [rng.choice(vocab) for _ in range(120)]
    rows = [(i, " ".join(base if i % 3 == 0 else edited(rng, other, vocab, i % 2) if i % 3 == 1 else [rng.choice(vocab) for _ in range(60)])) for i in range(600)]
    kept = near.drop_near(docs(spark, rows), 3, 90)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in brute_components(rows, 3, 90)})
    assert "sid" in kept.columns


def test_near_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s t"), (1, None), (1, None), (2, ""), (9, "a b c d e")]
    got = near.classes(docs(spark, rows), 3, 90).collect()
    assert {(r.doc_id, r.component_id) for r in got if r.n_shingles == 2} == {(5, 5), (None, 5), (None, None)}
    assert len(got) == len(rows)
    kept = near.drop_near(docs(spark, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, None), (2, ""), (5, "a b c d"), (9, "a b c d e")]
    assert [r.text for r in kept if r.doc_id is None] == ["q r s t"]
    assert near.drop_near(docs(spark, [])).count() == 0


def test_near_sql(spark, tmp_path):
    import duckdb

    rows = corpus(5, 30)
    docs(spark, rows, extra=False).toPandas().to_parquet(tmp_path / "d.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert sorted(c.sql(queries.oracle_sql()["op6_jaccard_join"]).fetchall()) == brute_components(rows, 3, 90)


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    raw = ("x" * 50 + " yy\tz\x0b\x0c " + "word " * 30 + "é" * 40).encode()
    want = near.word_hashes(raw)
    assert len(want) == len(raw.split())
    for piece in (1, 7, 64):
        monkeypatch.setattr(near, "PIECE", piece)
        assert (near.word_hashes(raw) == want).all()


def test_components_brute(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)]
    parent = {v: v for e in edges for v in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in components.components(spark.createDataFrame([(a, b) for a, b in edges], "a long, b long")).collect()}
    assert got == {v: find(v) for e in edges if e[0] != e[1] for v in e} | {k: v for k, v in got.items() if k not in parent}


# Benchmark items


def words_of(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_contained(rows, items, n=5):
    out = set()
    for i, t in rows:
        w = words_of(t)
        for j, x in items:
            v = words_of(x)
            k = min(n, len(v))
            if not k:
                continue
            a = set(zip(*[v[s:] for s in range(k)]))
            b = set(zip(*[w[s:] for s in range(k)])) if len(w) >= k else set()
            if 10 * len(a & b) >= 8 * len(a):
                out.add((i, j, len(a & b), len(a)))
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
def test_contained_brute(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    rng = random.Random(6)
    vocab = vocabulary(rng, 150)
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 17, 33, 60])))) for j in range(30)] + [(99, None), (98, "..."), (97, "same item words once more"), (96, "Same, item words once more!")]
    rows = []
    for i in range(250):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 200))]
        for _ in range(rng.randrange(3)):
            v = words_of(rng.choice(items)[1])
            v = edited(rng, v, vocab, rng.randrange(3)) if v else v
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", " -"]) for x in v]
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (301, "again same item words once more"), (301, "again same item words once more"), (None, "same item words once more")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("h", F.lit("mine")).withColumn("size", F.lit(1))
    got = [(r.doc_id, r.item_id, r.n_shared, r.size) for r in decontam.contained(docs(spark, rows), bench).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_contained(rows, items)
    left = decontam.drop_contaminated(docs(spark, rows), bench)
    bad = {i for i, *_ in brute_contained(rows, items)}
    assert sorted(r.doc_id for r in left.where("doc_id < 300").collect()) == [i for i in range(250) if i not in bad]
    assert left.where("doc_id IS NULL").count() == 0 and "row_key" in left.columns


@pytest.mark.parametrize("limit", [0, 10**6])
def test_contained_items_without_id(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    items = [(None, "one two three four five six"), (None, "red green blue white black grey"), (7, "one two three four five six")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "zero one two three four five six seven"), (2, "red green blue white black grey"), (3, "nothing of it here at all")]
    got = [(r.doc_id, r.item_id, r.n_shared, r.size) for r in decontam.contained(docs(spark, rows), bench).collect()]
    assert sorted(got, key=str) == sorted([(1, None, 2, 2), (1, 7, 2, 2), (2, None, 2, 2)], key=str)
    both = docs(spark, [(4, items[0][1] + " " + items[1][1])])
    assert decontam.contained(both, bench.where("item_id IS NULL")).count() == 2
    assert [r.doc_id for r in decontam.drop_contaminated(docs(spark, rows), bench.where("item_id IS NULL")).collect()] == [3]


def test_signatures_leave_room_for_what_may_be_missing(spark):
    """Whatever shingles of an item are missing, up to the threshold, enough of its signature is left."""
    rng = random.Random(2)
    items = [(j, " ".join(f"w{j}x{k}" for k in range(n))) for j, n in enumerate([1, 5, 6, 9, 10, 14, 24, 29, 60, 131])]
    rows = decontam.item_table(spark.createDataFrame(items, "item_id long, text string")).collect()
    for j, t in items:
        mine = [r for r in rows if r.item_id == j]
        signed = [r.h for r in mine if r.signed]
        assert len(mine) == max(1, len(t.split()) - 4) == mine[0].size and 1 <= mine[0].agree <= len(signed)
        least = sorted(r.h for r in mine)[: len(signed)]
        assert sorted(signed) == least
        for _ in range(20):
            gone = set(rng.sample(sorted(r.h for r in mine), mine[0].size - mine[0].need))
            assert sum(h not in gone for h in signed) >= mine[0].agree
        assert len(signed) - min(len(signed), mine[0].size - mine[0].need) == mine[0].agree


def test_sieve_loses_nothing(spark):
    some = spark.range(4000).select(F.xxhash64("id").alias("h"))
    left = {r.h for r in decontam.sieved(some, spark.range(0, 4000, 7).select(F.xxhash64("id").alias("h"))).collect()}
    want = {r.h for r in spark.range(0, 4000, 7).select(F.xxhash64("id").alias("h")).collect()}
    assert want <= left and len(left) < len(want) + 40


def test_drop_contaminated_keeps_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", "y"), (2, "q r s t u", "x", "y"), (2, "q r s t u", "x", "y")], "doc_id long, text string, row_key string, ROW_KEY_ string")
    left = decontam.drop_contaminated(df, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string"))
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(2, "q r s t u", "x", "y")] * 2


def test_contained_in_a_very_long_document(spark):
    rng = random.Random(9)
    vocab = vocabulary(rng, 5000)
    w = [rng.choice(vocab) for _ in range(60_000)]
    item = " ".join(rng.choice(vocab) for _ in range(30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, " ".join([*w[:50_000], item, *w[50_000:]])), (2, " ".join(w))]
    assert [(r.doc_id, r.containment) for r in decontam.contained(docs(spark, rows), bench).collect()] == [(1, 1.0)]


def test_contained_on_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    some = docs(spark, [(1, "a b c d e f")])
    assert decontam.contained(some, bench).count() == 0 and decontam.drop_contaminated(some, bench).count() == 1
    assert decontam.contained(docs(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# Repeated bytes


def brute_repeats(rows, length):
    seen: dict[bytes, int] = {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] = seen.get(b[k : k + length], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        inner = gone[1:-1]
        out.append((i, len(b), int(inner.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~inner])).hexdigest()))
    return sorted(out, key=str)


def repeat_corpus(seed):
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(rng.randrange(20, 120)) for _ in range(5)]
    rows = [text(rng.randrange(1, 80)) + " " + rng.choice(shared)[rng.randrange(60) :] + " " + text(rng.randrange(40)) for _ in range(60)]
    rows += ["a" * 199, "b" * 200, "c" * 201, "d" * 3000, "ab" * 400, "xyz" * 70 + text(50), shared[0], shared[0], shared[0][:250], "é" * 150, None, "", "same text again " * 40]
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "crowd"), [(1, 4096), (2, 2), (3, 8)])
def test_repeated_bytes_brute(spark, monkeypatch, seed, crowd):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = repeat_corpus(seed)
    got = [tuple(r) for r in substrings.digest(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)


def test_repeated_bytes_hot_passage_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", 16)
    rng = random.Random(5)
    vocab = vocabulary(rng)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, short = text(60), "Released under the terms of the licence found in the file. "
    rows = [(i, text(20) + passage + text(20)) for i in range(80)] + [(100 + i, short + text(60)) for i in range(80)] + [(7, passage + "x")] * 5 + [(None, passage), (None, None)]
    got = [tuple(r) for r in substrings.digest(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)


def test_repeated_bytes_nothing_to_find(spark):
    assert substrings.digest(docs(spark, [])).count() == 0
    assert [r.n_removed for r in substrings.digest(docs(spark, [(1, "short"), (2, None)])).collect()] == [0, 0]


def test_refine_brute():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([40, 50, 64])
        base = bytes(rng.choice(b"ab") for _ in range(80))
        windows = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))) + base[rng.randrange(40) :] for _ in range(rng.randrange(1, 6))]
        windows = [w for w in windows if len(w) >= length]
        if not windows:
            continue
        seen: dict[bytes, int] = {}
        for w in windows:
            for i in range(len(w) - length + 1):
                seen[w[i : i + length]] = seen.get(w[i : i + length], 0) + 1
        assert [x.tolist() for x in substrings.refine(windows, length)] == [[i for i in range(len(w) - length + 1) if seen[w[i : i + length]] > 1] for w in windows]


def test_runs_cover_every_position_once():
    rng = random.Random(4)
    for raw in [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (199, 200, 201, 900)] + [b"z" * 5000, b"ab" * 1000]:
        low, first, count, values, seen = substrings.text_runs(raw)
        covered = [p for f, n in zip(first.tolist(), count.tolist()) for p in range(f, f + n)]
        assert covered == list(range(max(0, len(raw) - 199)))
        assert set(low.tolist()) <= set(values.tolist()) and (count <= substrings.MAX_RUN).all()


def test_repeated_bytes_sql(tmp_path):
    import duckdb
    import pandas as pd

    rows = repeat_corpus(4)
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "d.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    assert sorted(c.sql(queries.oracle_sql()["op10_repeated_bytes"]).fetchall(), key=str) == brute_repeats(rows, 200)


def test_near_very_long_texts(spark):
    rng = random.Random(12)
    vocab = vocabulary(rng, 3000)
    long = [rng.choice(vocab) for _ in range(120_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:60_000] + ["edited"] + long[60_001:])), (3, " ".join(long[:50_000])), (4, "a short one"), (5, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near.classes(docs(spark, rows), 3, 90).orderBy("doc_id").collect()]
    assert got == brute_components(rows, 3, 90) and got[1][2] == 1


def test_repeated_bytes_very_long_texts(spark):
    rng = random.Random(13)
    vocab = vocabulary(rng, 3000)
    long = " ".join(rng.choice(vocab) for _ in range(60_000))
    rows = [(1, long), (2, "before " + long[150_000:150_300] + " after"), (3, "w " * 20_000), (4, None)]
    got = [tuple(r) for r in substrings.digest(docs(spark, rows)).collect()]
    assert sorted(got, key=str) == brute_repeats(rows, 200)
