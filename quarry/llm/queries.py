"""The registered queries of the training-data operators, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, chat, decontam, licenses, near, packing, pii, quality, substrings, tokens
from .common import read

MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.fit(docs, read(spark, sf_dir, "labels"))).drop("text")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As in the SQL, an item without an id names no pair.
    return decontam.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).where("item_id IS NOT NULL").drop("row_key")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(read(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digest(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.with_fixed(read(spark, sf_dir, "conversations")))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_classifier, op2_decontamination, op3_pii, op4_packing, op5_licenses, op6_jaccard_join, op7_audio, op8_token_counts, op9_chat, op10_repeated_bytes]
    return {f.__name__: f for f in found}


#: The words of a text in SQL: A-Z lowered, split at ASCII signs that are neither letters nor digits.
_SQL_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"

_OP2 = f"""
WITH i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
     i2 AS (SELECT item_id, least(5, len(w)) AS n, w FROM i WHERE len(w) > 0),
     s AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM i2, unnest(range(1, len(w) - n + 2)) AS t(k)),
     z AS (SELECT item_id, count(*) AS size FROM s GROUP BY item_id),
     d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
     c AS (SELECT DISTINCT d.doc_id, m.n, array_to_string(d.w[k : k + m.n - 1], ' ') AS g
           FROM d, (SELECT DISTINCT n FROM s) AS m, unnest(range(1, greatest(1, len(d.w) - m.n + 2))) AS t(k))
SELECT c.doc_id, s.item_id, count(*) AS n_shared, any_value(z.size) AS size, count(*) / any_value(z.size)::DOUBLE AS containment
FROM c JOIN s ON c.g = s.g AND c.n = s.n JOIN z ON z.item_id = s.item_id
GROUP BY c.doc_id, s.item_id HAVING 10 * count(*) >= 8 * any_value(z.size)
"""

_OP6 = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 2], ' ') AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS t(k) WHERE len(w) > 0),
     z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM s AS x JOIN s AS y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
     e AS (SELECT a, b FROM p JOIN z AS x ON x.doc_id = a JOIN z AS y ON y.doc_id = b WHERE 100 * same >= 90 * (x.n + y.n - same)),
     l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
     r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, min(r.other) AS component_id
FROM d LEFT JOIN z ON z.doc_id = d.doc_id JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id, z.n
"""

_OP9 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     f AS (SELECT *, 8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) + length(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;')) + 5 AS said,
                  row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
     g AS (SELECT *, sum(said) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS stop FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(stop) FILTER (role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM g GROUP BY conv_id
"""

#: Strings of 200 bytes start at k, from 1; starts that are 200 or fewer apart lie in one run of removed bytes.
_OP10 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
     s AS (SELECT r, k, hash(substr(x, 2 * k - 1, 400)) AS g FROM d, unnest(range(1, greatest(1, length(x) // 2 - 198))) AS t(k)),
     n AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
     b AS (SELECT r, k FROM s WHERE g IN (SELECT g FROM n)),
     e AS (SELECT r, k, k - lag(k) OVER (PARTITION BY r ORDER BY k) AS gap FROM b),
     i AS (SELECT r, k, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY k) AS island FROM e),
     c AS (SELECT r, min(k) AS first, max(k) + 199 AS last FROM i GROUP BY r, island),
     g AS (SELECT r, first, last, lag(last, 1, 0) OVER (PARTITION BY r ORDER BY first) AS before FROM c),
     k AS (SELECT r, count(*) AS spans, sum(last - first + 1) AS removed, max(last) AS stop, list(struct_pack(a := before, b := first) ORDER BY first) AS gaps FROM g GROUP BY r)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(array_to_string(list_transform(gaps, lambda z: substr(x, 2 * z.a + 1, 2 * (z.b - 1 - z.a))), '') || substr(x, 2 * stop + 1), x))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op6_jaccard_join": _OP6, "op9_chat": _OP9, "op10_repeated_bytes": _OP10}
