"""Scoring of whole texts with a small model, and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import materialize, sampled, slices, tidy


def score_texts(docs: DataFrame, model, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``docs`` and ``score``, which ``model.score(texts)`` gives for its whole text.

    ``model`` is of bounded size and broadcast; null texts reach it as empty ones.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = held.value.score([t.as_py() or "" for t in b.column(n)])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(scores, pa.float64())], names=[*columns, "score"])

    rows = docs.select(*columns, F.col("text").cast("string").alias("_text"))
    schema = docs.select(*columns).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(tidy(run), schema)


def filter_texts(docs: DataFrame, model, accept: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose scores ``accept`` takes."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.filter(pa.array(accept(held.value.score([t.as_py() or "" for t in b.column(at)])), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def sample_texts(docs: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """``ids`` (a bounded sample) with the ``text`` of each, stored: the corpus is scanned once, however often the sample is
    read.  The broadcast side has the sample's size; of rows that share an id the smallest text counts."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return materialize(rows.groupBy(*ids.columns).agg(F.min("text").alias("text")), label)


def measured(sample: DataFrame, measure: Callable[..., list], columns: list[str]) -> DataFrame:
    """``columns`` of a stored sample and ``features``, the list that ``measure(*values of columns, text)`` gives."""
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = zip(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array([measure(*r[:n], r[n] or "") for r in rows], pa.list_(pa.float32()))], names=[*columns, "features"])

    schema = sample.select(*columns).withColumn("features", F.lit(None).cast("array<float>")).schema
    return sample.select(*columns, "text").mapInArrow(tidy(run), schema)


def sample_ids(docs: DataFrame, keep: Column, n: int, seed: int) -> DataFrame:
    """At most ``n`` ids of ``docs`` that meet ``keep``, those with the smallest hashes."""
    return sampled(docs.where("doc_id is not null").where(keep), n, F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"))
