"""A corpus from documents to packed sequences: what is toxic, of low quality, a near copy or contaminated goes.

Every stage works on all that its predecessor kept and is written before the next one reads it, so that a lost executor
costs a re-read at most; what the next one has read goes.  All stages but the last return the columns of ``documents``.

Defined cases, of all stages: an empty table, or one of which nothing is left, gives no rows; columns beyond those of
``documents``, whatever their names, pass through all stages but the last; rows without an id are kept by the judgement of
their text alone; a null text counts as the empty one; texts of any length are judged whole; rows that share an id are
judged each, by their texts, and of equal ones near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolake.llm import decontaminate, near_dedup, packing, quality, toxicity
from echolake.llm.base import delete, fresh_path, swept, table
from echolake.llm.texts import filter_texts


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores under 0.5.  Learnt from the labelled rows of ``docs`` outside the held-out fold; without labels
    of both kinds the score is the share of toxic ones."""
    return filter_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), lambda score: score < 0.5)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text scores 0.5 or more.  Learnt from the trusted positives that are left; without any, all are kept."""
    return filter_texts(docs, quality.train(docs, table(spark, sf_dir, "labels")), lambda score: score >= 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (four-word shingles, similarity 0.8) the row of the smallest id; texts without words and
    rows without an id of their own group stay."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are not contaminated; those without words are clean."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), mode="document")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row with its sequence; a null text is the end id alone."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The trained stages cannot be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with swept(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
