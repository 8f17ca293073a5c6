"""The pipeline's stages on the smallest tables: each works on what the last one kept, and its decisions take effect."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import pii
from quarry.llm.common import cut

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the tables are not here")


def shingles(text, n, rx):
    w = re.findall(rx, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(*[w[k:] for k in range(n)])) if len(w) >= n else {tuple(w)} if w else set()


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = cut(stage(spark, docs, str(SF)))
        assert docs.columns == columns
        seen.append(docs.toPandas())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(SF)).toPandas()
    start, good, apart, clean, masked = seen
    assert len(start) > len(good) > len(apart) >= len(clean) == len(masked) > 0
    # Near copies: what is left is pairwise apart, and what went links with something that came in.
    words = r"[^\x20\x09-\x0D]+"
    sets = [shingles(t, 5, words) for t in apart.text]
    for a, x in enumerate(sets):
        for y in sets[:a]:
            if x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)):
                assert 100 * len(x & y) < 80 * len(x | y)
    before = {i: shingles(t, 5, words) for i, t in zip(good.doc_id, good.text)}
    for gone in set(good.doc_id) - set(apart.doc_id):
        assert any(i != gone and 100 * len(x & before[gone]) >= 80 * len(x | before[gone]) for i, x in before.items())
    # Benchmark items: none is left, and only documents with one went.
    signs = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    items = [shingles(t, 5, signs) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    dirty = {i for i, t in zip(apart.doc_id, apart.text) for x in [shingles(t, 5, signs)] if any(it and 10 * len(it & x) >= 8 * len(it) for it in items)}
    assert set(clean.doc_id) == set(apart.doc_id) - dirty
    # Personal data is gone from texts that are otherwise the same.
    anchors = pii.automaton()
    for a, b in zip(clean.sort_values("doc_id").text, masked.sort_values("doc_id").text):
        assert b == pii.redact(a, pii.find(a, anchors)) and not re.search(r"[\w.]+@[\w-]+\.\w", b)
    assert set(packed.doc_id) == set(masked.doc_id) and (packed.groupby("bin").n_words.sum() <= 2048).all()
    assert packed.n_words.sum() == sum(len(t.encode().split()) for t in masked.text)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns named as the operators' own: nothing crashes,
    nobody's column changes, and what a stage doesn't decide on stays."""
    long = "word " * 30_000
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + ".", "en", f"s{i % 3}", 9) for i in range(30)]
    rows += [(None, "an honest line of text without an id.", None, None, None), (40, None, None, "s", None), (41, "", "en", None, 0), (42, long, "en", "s", len(long)), (43, "write to joe@ex.org today", "en", "s", 25)]
    rows += [(50, "the same row twice, word for word.", "en", "s", 34)] * 3
    names = ("spans", "redacted", "weak_label", "quality", "toxic", "keep", "row_key", "row_key_", "cluster", "bin", "h", "words", "key", "target", "sid")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in names:
        df = df.withColumn(c, F.lit("mine"))
    spark.createDataFrame([(1, "no such item in any of these rows at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut(stage(spark, docs, str(tmp_path)))
        assert after.schema.names == df.schema.names, name
        assert after.where(" OR ".join(f"`{c}` <> 'mine'" for c in names)).count() == 0, name
        docs = after
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert (43, "write to [EMAIL] today") in got and (40, None) in got and (41, "") in got
    assert docs.where("doc_id = 50").count() == 1 and docs.where("doc_id < 30").count() == 30
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("part = 0").count() == docs.count()
    none = df.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    df.limit(0).drop(*names).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
