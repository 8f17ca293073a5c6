"""Narrow operators against brute force: personal data, token counts, licenses, audio, chat, packing, quality."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import audio, chat, licenses, packing, pii, quality, queries, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "é" * 3, "x" * 300_000, "word " * 20_000, "a\x00b", "😀 ok", "▁▁ a"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clash(df):
    """df with columns whose names the operators use themselves."""
    for c in ("spans", "redacted", "n_tokens", "media", "found", "kept", "keep", "quality", "row_key", "h", "bucket", "a", "b"):
        df = df.withColumn(c, F.lit("mine"))
    return df


# Personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans_equal_expressions():
    rng = random.Random(11)
    anchors = pii.automaton()
    alphabet = "ab1290.@+- ()x%é"
    cases = ["a@b.c@d.e", "a@b..c", "x@y.z.", "1.2.3.4.5.6.7.8", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 1", "+1 (555) 123-4567", "+1+12345678901", "++1234567890", "@a.b", "a@b.c.d.e@f.g.h", "1..2.3.4.5"]
    cases += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    cases += ["".join(rng.choice("0123 -.+") for _ in range(40)) for _ in range(2000)]
    for t in cases:
        assert [s for s in pii.find(t, anchors) if s[1] < 4] == base_spans(t), t


def test_pii_extra_kinds_and_redaction():
    anchors = pii.automaton()
    text = "see https://a.example/x?y=1, IBAN: DE89 3704 0044 0532 0130 00. Mail me: joe@ex.org"
    spans = pii.find(text, anchors)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in spans if k != 2] == [("url", "https://a.example/x?y=1"), ("account", "DE89 3704 0044 0532 0130 00"), ("email", "joe@ex.org")]
    out = pii.redact(text, spans)
    assert "joe@" not in out and "[EMAIL]" in out and "[URL]" in out and "0532" not in out


def test_pii_query_on_odd_texts(spark):
    rows = pii.digest(clash(docs(spark, [*ODD, "a@b.co 1.2.3.4"]))).orderBy("doc_id").collect()
    assert [r.n_email for r in rows] == [0] * len(ODD) + [1]
    assert rows[0].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[-1].spans == "email:0:6,ip:7:14"
    assert rows[-1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert pii.digest(docs(spark, [])).count() == 0
    scanned = pii.scan(clash(docs(spark, [None, "a@b.co"]))).orderBy("doc_id").collect()
    assert [r.redacted for r in scanned] == ["", "[EMAIL]"] and scanned[1].keep == "mine"


# Token counts


def test_tokens_equal_the_library(spark):
    path = queries.tokenizer_path()
    sp = tokens.load(path)
    rng = random.Random(5)
    texts = [*ODD[1:], "</s>[INST] ok", "a  b   c ", "  lead", "tab\tx\r\ny", "İ①ﬁ", "<0x0A> <unk>"]
    texts += ["".join(rng.choice(["the ", "a", " ", "▁", "\n", "é", "日本", "zx", "  ", "!"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    table = tokens.frequent(path)
    assert table and len(table) < sp.get_piece_size()
    want = [len(sp.encode(t)) for t in texts]
    assert tokens.counter(path, table)(texts) == want
    assert tokens.counter(path, None)(texts) == want
    small = tokens.CACHE
    try:
        tokens.CACHE = len(table) + 5  # caches that overflow all the time
        assert tokens.counter(path, table)(texts) == want
    finally:
        tokens.CACHE = small
    got = tokens.token_report(clash(docs(spark, [None, *texts[:20]])), path, limit=5).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [0, *want[:20]] and [r.over_limit for r in got] == [False, *(w > 5 for w in want[:20])]
    assert got[1].n_bytes == 0 and tokens.token_report(docs(spark, []), path).count() == 0


def test_frequent_pre_tokens_are_counted_over_all(spark, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE", 3)
    texts = ["the the the of of a " * 30 + " ".join(f"w{i}x{k}" for k in range(200)) for i in range(40)] + [None, ""]
    df = docs(spark, texts).repartition(3)
    assert tokens.most_frequent(df, bound=3) == [" the", " of", " a"]
    assert tokens.most_frequent(df.limit(0)) == []
    path = queries.tokenizer_path()
    sp = tokens.load(path)
    for table in ({}, tokens.frequent(path, [" the", " "])):
        assert tokens.counter(path, table)([t or "" for t in texts]) == [len(sp.encode(t or "")) for t in texts]
    assert tokens.worker(path)[1] and tokens.counter(path, {" the": 1}) is not None


# Licenses


def test_license_rules_are_many_and_gated():
    rules = licenses.rules()
    assert len(rules) > 200
    assert all(re.compile(rx) for *_, rx, _ in rules)
    # What a rule can match holds a gate word: its expression names one, or its keyword is one.
    assert all(re.search(r"licen|copyright|gpl|cc0|commons|domain|rights|cc by|gfdl", rx) or rank < 3 or re.search(licenses.GATE, keyword) for rank, (_, _, keyword, rx, _) in enumerate(rules))


def matches(parsed):
    """Shortest texts that an expression matches, at least one for each of its alternatives."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "BRANCH":
            more = [t for branch in arg[1] for t in matches(branch)]
        elif name == "SUBPATTERN":
            more = matches(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [t * arg[0] for t in matches(arg[2])] if arg[0] else [""]
        elif name == "LITERAL":
            more = [chr(arg)]
        else:  # one of a class: a letter of the set, a digit or what is no space
            more = [next((chr(v) for o, v in arg if str(o) == "LITERAL"), "7") if name == "IN" else "7"]
        out = [a + b for a in out for b in more]
    return list(dict.fromkeys(out))


def rule_matches():
    """(rule, a text) for each alternative of each rule."""
    from re import _parser

    for rule in licenses.rules():
        for t in matches(_parser.parse(rule[3])):
            assert re.fullmatch(rule[3], t), (rule, t)
            yield rule, t


def test_license_gate_passes_what_rules_match():
    for rule, t in rule_matches():
        for text in (t, t.upper(), f"x\n{t.replace(' ', '-')}.", f"({t.replace(' ', chr(10) + '  ')})"):
            assert re.search(licenses.GATE, text), (rule, text)


def test_license_keywords_are_in_all_matches():
    for (_, _, keyword, *_), t in rule_matches():
        assert keyword in f" {t} ", (keyword, t)


def test_license_keywords_of_alternatives(spark):
    texts = ["Released under Creative Commons Zero 1.0", "Copyright 2020 A. Author, 2-clause BSD", "3-Clause BSD", "four clause BSD", "Zero-clause BSD", "the 2-clause license", "BSD 2-clause license"]
    got = [r.labels for r in licenses.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["cc0", "bsd-2,copyright", "bsd-3", "bsd-4", "bsd-0", "bsd-2", "bsd-2"]


MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""


def test_license_mit_notice(spark):
    start = MIT_NOTICE.split(" (the")[0]
    texts = [MIT_NOTICE, MIT_NOTICE.replace("\n", "\n// "), start, start.split(" and associated")[0], "Copyright (c) 2020 A. Author\n\n" + MIT_NOTICE, start.replace("this software", "the work") + " under this license", start.replace("this software", "the work")]
    got = [r.labels for r in licenses.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["mit", "mit", "mit", "mit", "copyright,mit", "mit", ""]


def test_license_short_names(spark):
    texts = ["Source is under MPL 2.0", "OFL 1.1", "EUPL-1.2", "EPL-2.0", "CDDL v1.1", "GNU FDL 1.2", "MS-PL 1.0", "CeCILL 2.1", "2-clause BSD", "Released as SSPLv1", "no MPL, no AFL here"]
    got = [r.labels for r in licenses.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got[:8] == ["mpl-2", "ofl-1.1", "eupl-1.2", "epl-2", "cddl-1.1", "fdl-1.2", "ms-pl-1", "cecill-2.1"]
    assert got[9:] == ["sspl-1", ""]


PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


def license_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_license_base_places(spark):
    rng = random.Random(8)
    parts = ["under", "the", "MIT", "license", "Apache", "License,", "Version", "2.0", "2", "cc", "CC-BY", "by", "nc", "BY-NC", "é", "K", "İ", "-", "\n", "x"]
    texts = [*ODD, "Under the MIT License under the mit license", "cc by nc cc by nc by nc", "CC BY-NC 4.0", "cc\x00by\x7fnc", "cc by ncé", "écc by nc"]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    got = licenses.digest(clash(docs(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.digest(docs(spark, [])).count() == 0


def test_license_suppression(spark):
    texts = ["Licensed under the Apache License, Version 2.0", "GNU General Public License version 3 or later", "GNU Lesser General Public License v2.1 only", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0", "the 3-Clause BSD license", "Mozilla Public License 2.0 and the MIT License", "dedicated to the public domain", "no word of it"]
    got = [r.labels for r in licenses.digest(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["apache-2", "gpl-3-or-later", "lgpl-2.1-only", "cc-by-sa-4.0", "cc-by-sa-3.0", "bsd-3", "mit,mpl-2", "public-domain", ""]
    found = licenses.detect(docs(spark, texts[1:2])).first()
    assert len(found.found) > len(found.kept) == 1


def found_by_python(text):
    """All rules' matches by this language's own expressions, no gate and no keywords, in order."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    plain = f" {' '.join(words)} "
    out = []
    for rank, (priority, label, _, rx, score) in enumerate(licenses.rules()):
        for m in re.finditer(f"(?<= )(?:{rx})(?= )", plain):
            first = plain.count(" ", 0, m.start()) - 1
            out.append((first, first + m[0].count(" ") + 1, priority, rank, label, score))
    return sorted(out, key=lambda d: (d[0], -d[1], d[2], d[3]))


def kept_by_pairs(found):
    """Each match against each other one."""

    def weaker(d, e):
        inside, around = e[0] <= d[0] and d[1] <= e[1], d[0] <= e[0] and e[1] <= d[1]
        if inside and (e[2] < d[2] or (e[2] == d[2] and (e[:2] != d[:2] or e[3] < d[3]))):
            return True
        return around and e[2] < d[2]

    return [d for d in found if d[2] == 0 or not any(weaker(d, e) for e in found if e is not d)]


def test_license_found_and_kept_brute(spark):
    rng = random.Random(9)
    samples = [t for _, t in rule_matches()]
    texts = [*samples, MIT_NOTICE]
    for _ in range(400):
        parts = [rng.choice(samples) if rng.random() < 0.6 else rng.choice(["or later", "version", "2", "license", "x", "only", "at your option"]) for _ in range(rng.randrange(1, 7))]
        texts.append(" ".join(parts).replace(" ", rng.choice([" ", "-", "\n "])))
    texts.append(" ".join(rng.choice(samples) for _ in range(400)))  # more matches than a block of the folds has
    for r in licenses.detect(docs(spark, texts)).select("text", "found", "kept").collect():
        found = found_by_python(r.text)
        assert [tuple(d) for d in r.found] == found, r.text
        alone = [d for d in found if d[2] > 0] if len(found) > 1 else found
        assert [tuple(d) for d in r.kept if d.priority > 0 or len(found) == 1] == [d for d in kept_by_pairs(found) if d in alone], r.text


def test_license_many_matches_and_clashing_names(spark):
    import time

    many = "Under the MIT License. " * 45_000
    df = docs(spark, [many, "cc by nc"]).withColumn("words", F.lit("mine")).withColumn("Numbered", F.lit("mine"))
    licenses.digest(df.limit(0)).count()
    began = time.time()
    got = licenses.digest(df).orderBy("doc_id").collect()
    assert (got[0].n_base, got[0].last_word, got[0].labels) == (45_000, 4 * 45_000 - 4, "mit") and got[1].labels == "cc-by-nc"
    assert time.time() - began < 60
    assert {(r.words, r.Numbered) for r in licenses.detect(df).select("words", "Numbered").collect()} == {("mine", "mine")}


# Audio


def test_audio_round_trip(spark):
    texts = [t for t in ODD if t != ODD[6]] + ["x" * 192, "x" * 193, "dup", "dup"]
    got = audio.digest(clash(docs(spark, texts))).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        media = audio.wav(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[-1].feature == got[-2].feature != got[-3].feature
    assert audio.digest(docs(spark, [])).count() == 0


def test_wav_is_one_that_the_standard_library_reads():
    import io
    import wave

    with wave.open(io.BytesIO(audio.wav(bytes(range(192)))), "rb") as w:
        assert (w.getframerate(), w.getsampwidth(), w.getnchannels(), w.readframes(192)) == (16_000, 1, 1, bytes(range(192)))


def test_resampling_is_polyphase():
    x = np.random.default_rng(1).normal(size=500).astype(np.float32)
    h = audio.filters()
    want = []
    for k in range(-(-len(x) * audio.UP // audio.DOWN)):
        phase, first = (k * audio.DOWN) % audio.UP, (k * audio.DOWN) // audio.UP
        want.append(sum(h[phase][::-1][j] * x[min(max(first - audio.TAPS // 2 + j, 0), len(x) - 1)] for j in range(audio.TAPS)))
    assert audio.resample(x) == pytest.approx(want, abs=1e-4)
    assert audio.resample(np.ones(64, np.float32)) == pytest.approx(np.ones(48), abs=1e-5)


def test_tone_segments_and_tensors():
    t = np.arange(16_000) / 16_000
    loud = np.where((t > 0.25) & (t < 0.75), 100, 2) * np.sin(2 * np.pi * 1000 * t)
    mel = audio.log_mel(bytes((loud + 128).astype(np.uint8)))
    seconds = audio.HOP * audio.DOWN / audio.UP / audio.RATE
    spans = audio.segments(mel.mean(axis=1)) * seconds
    assert len(spans) == 1 and spans[0] == pytest.approx([0.25, 0.75], abs=0.05)
    array = audio.tensors(mel)
    assert isinstance(array.type, pa.FixedShapeTensorType) and list(array.type.shape) == [audio.BLOCK, audio.BANDS]
    assert (audio.from_ipc(audio.to_ipc(array)).reshape(-1, audio.BANDS)[: len(mel)] == mel).all()


def test_frames_cover_the_end():
    for n in (192, 384, 576, 768, 960, 1920):
        x = np.full(n, 128, np.uint8)
        quiet = audio.log_mel(x.tobytes())
        size = -(-n * audio.UP // audio.DOWN)
        assert len(quiet) == max(1, 1 + -(-(size - audio.FRAME) // audio.HOP))
        x[-60:] = 128 + 100 * np.sin(np.arange(60))
        assert not np.array_equal(audio.log_mel(x.tobytes())[-1], quiet[-1])
    x = np.full(16_000, 128, np.uint8)
    x[-230:] = 128 + 100 * np.sin(np.arange(230))
    assert audio.segments(audio.log_mel(x.tobytes()).mean(axis=1))[-1, 1] == len(audio.log_mel(x.tobytes()))


def test_hysteresis_brute():
    rng = np.random.default_rng(2)
    for _ in range(200):
        e = rng.normal(size=rng.integers(1, 40))
        level, on, want = (e - e.mean()) / max(e.std(), 1e-6), False, []
        for v in level:
            on = True if v > audio.HIGH else False if v < audio.LOW else on
            want.append(on)
        got = np.zeros(len(e), bool)
        for a, b in audio.segments(e):
            got[a:b] = True
        assert got.tolist() == want


# Chat

CONVS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "<|end|>\n", "<|assistant|>\n", "&lt;", "&amp;#91;", "|", "<", "\n", "x", "é", "&", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a|>\nb", "", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(6))])) for c in range(60) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "assistant", "lost"), (5, 0, "assistant", "tie")]
    df = chat.with_fixed(spark.createDataFrame(rows, CONVS).withColumn("example", F.lit(1)))
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digest(df).collect()}
    assert got == want
    ex = chat.format_examples(df).where("conv_id = -7").collect()
    assert len(ex) == 1 and "</s>" not in ex[0].formatted and "[INST]" not in ex[0].formatted
    assert chat.digest(df.limit(0)).count() == 0


def test_chat_examples_hold_their_context(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (1, 4, "user", "e")], CONVS)
    ex = chat.format_examples(df).orderBy("example").collect()
    assert [(e.n_turns, e.formatted[e.loss_start : e.loss_start + e.loss_length] if e.loss_start is not None else None) for e in ex] == [(2, "b"), (4, "d"), (5, None)]
    assert ex[1].formatted.startswith(ex[0].formatted)


# Packing


def test_packing_constraints(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 99, 100, 101, 250])) + rng.choice(["", f" u{i}"]), None if i % 11 == 0 else f"s{0 if i % 3 == 0 else i % 7}") for i in range(400)] + [(7, None, "s1"), (7, None, "s1"), (None, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bin", F.lit("mine"))
    got = packing.pack(df, capacity=100, per_source=2, shard_rows=150).collect()
    by_doc, by_bin = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.cluster), []).append(r)
        by_bin.setdefault(r.bin, []).append(r)
    assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(r.part == 0 for r in got) == len(rows)
    for b in by_bin.values():
        assert sum(r.n_words for r in b) == b[0].fill <= 100
        spans = sorted((r.start, r.start + r.n_words) for r in b)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert len({r.cluster for r in b}) == len(b)
        assert all(sum(r.source == s for r in b) <= 2 for s in {r.source for r in b})
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_takes_clusters(spark):
    rows = [(i, f"word{i} " * (5 + i % 3), f"s{i}", i // 4 if i < 32 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, component_id long")
    got = packing.pack(df, capacity=100, cluster="component_id").collect()
    bins = {}
    for r in got:
        bins.setdefault(r.bin, []).append(r.doc_id)
    assert sorted(r.doc_id for r in got) == list(range(40)) and max(map(len, bins.values())) > 4
    assert all(len({i // 4 for i in b if i < 32}) == sum(i < 32 for i in b) for b in bins.values())
    assert len({r.cluster for r in got}) == 16


def test_packing_full_bins_and_ids_of_any_kind(spark, monkeypatch):
    """Equal texts from two sources, null ids, ids beyond 2^53 beside nulls, texts as ids, rows with very many copies."""
    monkeypatch.setattr(packing, "COPIES", 3)
    full, big = "w " * 2048, 9007199254740993
    rows = [(1, full, "a"), (1, full, "b"), (None, full, "a"), (None, full, "b"), (None, full, None), (big, "a b", "x"), (None, "c", "x")] + [(2, full + "x", "a")] * 11
    for kind in ("long", "string"):
        df = spark.createDataFrame([(i if i is None or kind == "long" else f"id {i}", t, s) for i, t, s in rows], f"doc_id {kind}, text string, source string")
        got = packing.pack(df.withColumn("cluster", F.lit("mine"))).collect()
        assert sum(r.n_words for r in got) == sum(len(t.split()) for _, t, _ in rows)
        assert {r.doc_id for r in got} == {i if i is None or kind == "long" else f"id {i}" for i, *_ in rows}
        bins = {}
        for r in got:
            bins.setdefault(r.bin, []).append(r)
        for b in bins.values():
            assert sum(r.n_words for r in b) == b[0].fill <= 2048 and len({r.cluster for r in b}) == len(b)
        assert sum(r.doc_id in (2, "id 2") for r in got) == 22


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(100):
        items = sorted(((rng.randrange(1, 50), rng.randrange(4), rng.randrange(6)) for _ in range(40)), reverse=True)
        got = packing.pack_shard(*map(list, zip(*items)), 60, 2)
        bins: list = []
        for (n, s, c), (at, start) in zip(items, got):
            fits = [(60 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + n <= 60 and sum(x[1] == s for x in b) < 2 and all(x[2] != c for x in b)]
            want = min(fits)[1] if fits else len(bins)
            assert at == want
            if want == len(bins):
                bins.append([])
            assert start == sum(x[0] for x in bins[want])
            bins[want].append((n, s, c))


# Quality


def prose(rng, n=60):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng):
    words = prose(rng).split()
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in words), lambda: " ".join(w + rng.choice(["###", "$$$", "&&&", "%%%"]) for w in words), lambda: " ".join(w for w in words[:8] for _ in range(9)), lambda: "\n".join(" | ".join(words[i : i + 4]) for i in range(0, 60, 4))])()


def test_quality_held_out_accuracy(spark):
    rng = random.Random(12)
    rows = [(i, junk(rng) if i % 5 == 0 else prose(rng) + (" you idiot moron" if i % 5 == 1 and i % 2 else "")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 5 == 1 and i % 2)) for i in range(1000)], "doc_id long, quality int, toxic int")
    model = quality.fit(df.where("doc_id < 1000"), labels)
    held = quality.classify(clash(df.where("doc_id >= 1000")), model).collect()
    assert np.mean([(r.quality >= 0.5) == (r.doc_id % 5 != 0) for r in held]) > 0.97
    assert np.mean([(r.toxic >= 0.5) == (r.doc_id % 5 == 1 and r.doc_id % 2 == 1) for r in held]) > 0.97
    assert held[0].a == "mine"


def test_quality_on_odd_texts_and_empty_tables(spark):
    df = docs(spark, ODD)
    model = quality.fit(df, None)
    assert quality.classify(df, model).where("quality IS NOT NULL AND keep IS NOT NULL").count() == len(ODD)
    none = quality.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert quality.classify(df, none).count() == len(ODD)


def test_quality_learns_from_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(prose(rng) for _ in range(180))
    assert len(long) > 50_000
    rows = [(i, (long if i % 2 else prose(rng)) + (" you idiot moron" if i % 4 == 1 else "")) for i in range(160)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 1)) for i in range(160)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(df, labels)
    assert len(model["toxic"][0]) <= quality.FEATURES
    assert all((r.toxic >= 0.5) == (r.doc_id % 4 == 1) for r in quality.classify(df, model).collect())


def test_telling_features_are_those_of_training(spark):
    rng = random.Random(5)
    texts = [junk(rng) if i % 3 == 0 else prose(rng) for i in range(300)]
    df = spark.createDataFrame([(t, int(i % 3 == 0)) for i, t in enumerate(texts)], "text string, target int")
    hashed = quality.Hasher()
    whole = quality.train([quality.look(hashed, t)[1] for t in texts], np.array([float(i % 3 == 0) for i in range(300)]))
    rows = quality.featured(df)
    assert quality.train([np.array(r.features, np.int32) for r in rows], np.array([float(r.target) for r in rows]))[0].tolist() == whole[0].tolist()


def test_scorer_without_features_keeps_the_rate():
    rows = [np.array([i], np.int32) for i in range(40)]
    model = quality.train(rows, np.array([1.0] * 4 + [0.0] * 36))
    assert not len(model[0]) and quality.scorer(model)(rows[0]) == pytest.approx(0.1, abs=1e-3)


def test_em_recovers_labellers():
    rng = np.random.default_rng(7)
    truth = rng.random(4000) < 0.7
    skill = np.array([0.95, 0.9, 0.85, 0.8])
    votes = np.where(rng.random((4000, 4)) < skill, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, priors, confusion = quality.fit_labellers(patterns, counts.astype(float))
    assert ((posterior[inverse.ravel()] >= 0.5) == truth).mean() > 0.9
    assert confusion.shape == (5, 4, 2) and priors.sum() == pytest.approx(1)


def voted(rng, n=4000):
    """Votes of some labellers of uneven skill, which are wrong independently, and the truth."""
    labellers = rng.integers(3, 8)
    truth = rng.random(n) < rng.uniform(0.3, 0.85)
    on_good, on_bad = rng.uniform(0.6, 0.97, labellers), rng.uniform(0.6, 0.97, labellers)
    votes = np.where(truth[:, None], rng.random((n, labellers)) < on_good, rng.random((n, labellers)) >= on_bad).astype(int)
    votes[rng.random(votes.shape) < rng.uniform(0, 0.5, labellers)] = quality.ABSTAIN
    return votes, truth


@pytest.mark.parametrize("seed", range(10))
def test_em_is_at_least_as_good_as_majority(seed):
    votes, truth = voted(np.random.default_rng(seed))
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior = quality.fit_labellers(patterns, counts.astype(float))[0][inverse.ravel()]
    lead = (votes == quality.GOOD).sum(axis=1) - (votes == quality.BAD).sum(axis=1)
    assert ((posterior >= 0.5) == truth).mean() >= np.where(lead == 0, 0.5, (lead > 0) == truth).mean()


def test_em_brute():
    """The same steps in plain Python, one document at a time; classes by the model that is chosen."""
    votes, _ = voted(np.random.default_rng(3), 300)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.linspace(0.1, 0.9, len(patterns))
    smooth = np.ones((2, votes.shape[1], 2))
    value, posterior, priors, confusion = quality.expect(patterns, counts.astype(float), np.stack([start, 1 - start]), smooth, 5)
    mine = [[start[k], 1 - start[k]] for k in inverse.ravel()]
    for _ in range(5):
        prior = [1 + sum(m[c] for m in mine) for c in (0, 1)]
        prior = [p / sum(prior) for p in prior]
        table = [[[1 + sum(m[c] for m, v in zip(mine, votes) if v[j] == x) for x in (0, 1)] for j in range(votes.shape[1])] for c in (0, 1)]
        table = [[[x / sum(row) for x in row] for row in t] for t in table]
        joint = [[prior[c] * float(np.prod([table[c][j][v] for j, v in enumerate(row) if v != quality.ABSTAIN])) for c in (0, 1)] for row in votes]
        mine = [[x / sum(j) for x in j] for j in joint]
    assert posterior[0][inverse.ravel()] == pytest.approx([m[0] for m in mine]) and priors == pytest.approx(prior)
    assert confusion == pytest.approx(np.array(table)) and value == pytest.approx(sum(np.log(sum(j)) for j in joint))


def test_em_tells_kinds_of_trouble_apart():
    """Bad documents go wrong in one of four ways; one labeller knows that way, a fifth one complains about half of them."""
    rng = np.random.default_rng(5)
    kind = np.where(rng.random(6000) < 0.8, -1, rng.integers(0, 4, 6000))
    votes = np.where(kind[:, None] == np.arange(4), rng.random((6000, 4)) >= 0.98, rng.random((6000, 4)) < 0.998)
    votes = np.concatenate([votes, np.where(kind >= 0, rng.random(6000) >= 0.5, rng.random(6000) < 0.998)[:, None]], axis=1).astype(int)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, _, confusion = quality.fit_labellers(patterns, counts.astype(float))
    assert ((posterior[inverse.ravel()] >= 0.5) == (kind < 0)).mean() > 0.97
    assert confusion.shape == (6, 5, 2)


def test_quality_sample_is_repeatable(spark):
    rng = random.Random(3)
    rows = [(i % 40 if i % 7 else None, junk(rng) if i % 3 == 0 else prose(rng)) for i in range(300)]
    rows += [(5, rows[0][1])] * 50
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(3, 1, 0), (None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    made = [quality.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels.repartition(n), 50, 20) for n in (1, 5)]
    for head in ("quality", "toxic"):
        assert all(np.array_equal(a, b) for a, b in zip(made[0][head], made[1][head]))


def test_quality_columns_of_other_names(spark):
    df = clash(docs(spark, ODD))
    got = quality.classify(df, quality.fit(df), ("w", "q", "t", "ok")).first()
    assert (got.keep, got.quality) == ("mine", "mine") and 0 <= got.q <= 1


def test_audio_of_a_very_long_text(spark):
    text = ODD[6] + "é" * 100_001
    [r] = audio.digest(docs(spark, [text])).collect()
    payload = text.encode() + b" " * (-len(text.encode()) % 192)
    assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert r.feature.startswith(f"frames={len(audio.log_mel(payload))}|")
