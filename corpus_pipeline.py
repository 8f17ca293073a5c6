"""A corpus from raw documents to packed sequences, in stages that each call one operator.

Each stage takes the table that the last one wrote, and all but the last return the columns of documents: low-quality and
abusive documents go; one document of each near-duplicate group stays (word 5-grams, Jaccard 0.8); documents that hold
a benchmark item go; personal data is masked in the texts; what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, near, packing, pii, quality
from quarry.llm.common import cut, drop, fresh, read


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the classifier, fitted on these very rows, rejects.

    A null or empty text is judged like any other (nothing speaks against it); equal texts share their fate.
    """
    names = fresh(docs, *quality.ADDED)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.classify(docs, model, tuple(names)).where(F.col(names[-1])).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one of the least doc_id (nulls last).

    Texts without words (null, empty) are linked with nothing; of rows with equal doc_id and text one stays.
    """
    return near.drop_near(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that hold a benchmark item; null and empty texts hold none, repeated rows stay or go together."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each span of personal data replaced by its kind, and n_chars, where there is one, counted anew.

    All rows stay. A null text stays null, and its n_chars with it.
    """
    columns = docs.columns
    masked, spans = fresh(docs, "redacted", "spans")
    clean = pii.scan(docs, redacted=masked, spans=spans).withColumn("text", F.when(F.col("text").isNotNull(), F.col(masked)))
    if "n_chars" in columns:
        clean = clean.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return clean.drop(masked, spans)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all rows in sequences; a null or empty text has one part of no words, repeated rows one place each."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("personal_data", mask_personal_data), ("packing", pack_sequences)]

#: No SQL gives the rows of a trained classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each is written before the next one reads it, and removed after.

    Columns of documents that no stage knows pass through all but the last. An empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        if k:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
