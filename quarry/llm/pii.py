"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and identifier cues. A small
deterministic parser for each kind then expands around its anchors, in order and never twice over the same characters,
and validates what it found. Base kinds give exactly the leftmost non-overlapping matches of their expressions, less the
ones that fail validation; two kinds of the method's own, ``url`` and ``account``, come on top and remove nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches

KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "mailto:", "tel:")
CUES = ("iban", "ssn", "passport", "account", "acct", "konto", "cuenta", "compte", "routing", "swift")

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`\\^{}|]+")
ACCOUNT = re.compile(r"[\x20]*(?:number|no\.?|nr\.?|#)?[\x20]*[:=#]?[\x20]*([A-Z]{0,2}[0-9][0-9A-Z]*(?:[\x20-][0-9A-Z]*[0-9][0-9A-Z]*)*)", re.I | re.A)
DIGITS = "0123456789"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def automaton():
    """Anchors with their class; a cue also in capitals and with a capital first letter."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("cue", CUES)):
        for w in words:
            for x in {w, w.upper(), w.capitalize()}:
                a.add_word(x, (kind, len(x)))
    a.make_automaton()
    return a


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, index of kind, end), in order; end exclusive, in code points."""
    spans = []
    done = [0] * len(KINDS)  # up to where each kind has consumed the text
    for at, (what, size) in anchors.iter(text):
        start = at + 1 - size
        if what == "digit":
            before = text[start - 1] if start else ""
            if start >= done[1] and (start == done[1] or before not in DIGITS or not before) and (m := IP.match(text, start)):
                done[1] = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    spans.append((start, 1, done[1]))
            if start >= done[2] and (m := CARD.match(text, start)):
                done[2] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((start, 2, done[2]))
        elif what == "at":
            left = start
            while left > done[0] and text[left - 1] in LOCAL:
                left -= 1
            if left < start and (m := DOMAIN.match(text, start)):
                done[0] = m.end()
                spans.append((left, 0, done[0]))
        elif what == "plus":
            if start >= done[3] and (m := PHONE.match(text, start)):
                done[3] = m.end()
                if 10 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans.append((start, 3, done[3]))
        elif what == "scheme":
            if start >= done[4] and not (start and text[start - 1].isalnum()) and (m := URL.match(text, at + 1)):
                end = m.end()
                while end > at + 1 and text[end - 1] in ".,;:!?)]":
                    end -= 1
                if end > at + 1:
                    done[4] = end
                    spans.append((start, 4, end))
        elif start >= done[5] and not (start and text[start - 1].isalnum()) and (m := ACCOUNT.match(text, at + 1)):
            if 6 <= sum(c in DIGITS for c in m[1]) <= 34:
                done[5] = m.end(1)
                spans.append((m.start(1), 5, m.end(1)))
    spans.sort()
    return spans


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the one that begins first covers all."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, text: str = "text", redacted: str = "redacted", spans: str = "spans") -> DataFrame:
    """docs with ``spans`` (kind, start, end in code points, ordered) and the text without them in ``redacted``.

    A null text counts as empty: no spans, and an empty string. Equal texts have equal spans. Columns of these names are
    replaced; all others pass. A narrow step, a task holds one batch of rows.
    """
    docs = docs.drop(spans, redacted)
    names = docs.columns
    schema = T.StructType([*docs.schema, T.StructField(spans, SPANS), T.StructField(redacted, T.StringType())])

    def make():
        anchors = automaton()

        def step(batch):
            texts = [t or "" for t in batch.column(names.index(text)).to_pylist()]
            found = [find(t, anchors) for t in texts]
            return {n: batch.column(i) for i, n in enumerate(names)} | {
                spans: [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found],
                redacted: [redact(t, x) if x else t for t, x in zip(texts, found)],
            }

        return step

    return map_batches(docs, schema, make)


def digest(docs: DataFrame) -> DataFrame:
    """One row per row of docs: counts of the base kinds, a hash of the base spans, and all spans as text.

    A null or empty text has no spans: counts of 0, the hash of nothing, an empty string. Other columns are ignored; an empty
    table gives no rows."""

    def make():
        anchors = automaton()

        def step(batch):
            found = [find(t or "", anchors) for t in batch.column(1).to_pylist()]
            said = [[f"{KINDS[k]}:{s}:{e}" for s, k, e in x] for x in found]
            base = [",".join(t for t, (_, k, _) in zip(ts, x) if k < 4) for ts, x in zip(said, found)]
            return {"doc_id": batch.column(0)} | {f"n_{KINDS[i]}": [sum(k == i for _, k, _ in x) for x in found] for i in range(4)} | {"base_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in base], "spans": [",".join(x) for x in said]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make)
