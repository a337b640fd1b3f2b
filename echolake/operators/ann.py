"""Approximate nearest neighbours: vectors dealt to cells, of which a query searches the nearest few.

The index is a table: the store with the number of the centre that each vector is nearest to.  It is written like any table,
partitioned by ``cell`` if one likes, and grows by assigning what is new.  Centres are learnt on a bounded sample.  How many
cells a query must search for a wanted recall is measured, not guessed: :func:`tune` compares with exact search on a
stated sample of queries.  With all cells searched the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.operators.retrieval import BLOCK, _best, _matrix, knn, recall_at_k, top_k

SAMPLE = 20_000  # vectors that centres are learnt on, those of the smallest hashes
MOST_CELLS = 4_096  # centres are broadcast


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def centres(store: DataFrame, cells: int, rounds: int = 8, sample: int = SAMPLE) -> np.ndarray:
    """At most ``cells`` unit vectors, by spherical k-means on a sample of the vectors of the commonest length."""
    cells = min(cells, MOST_CELLS)
    rows = store.where(F.size("embedding") > 0)
    common = rows.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return np.zeros((0, 0))
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    # about twice the sample passes the first test, so that few rows of each task meet
    some = rows.where((F.size("embedding") == common["dim"]) & (place < int(min(1.0, (2 * sample + 100) / common["n"]) * (1 << 30))))
    drawn = some.orderBy(place, "vec_id").limit(sample).select("embedding").collect()
    x = _unit(np.array([r["embedding"] for r in drawn], dtype=np.float64))
    c = x[:: max(1, len(x) // cells)][:cells]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def build(store: DataFrame, centres: np.ndarray) -> DataFrame:
    """``store`` with ``cell``; null for vectors that are null or of another length, which no search finds."""
    held, at = store.sparkSession.sparkContext.broadcast(centres), store.columns.index("embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            column, cell = b.column(at), np.full(b.num_rows, -1, dtype=np.int32)
            sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), -1))
            fits = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.empty(0, dtype=np.int64)
            if len(fits):
                cell[fits] = (_unit(_matrix(column.take(pa.array(fits)))) @ c.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32(), mask=cell < 0)], names=[*b.schema.names, "cell"])

    return store.mapInArrow(run, store.withColumn("cell", F.lit(None).cast("int")).schema)


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 3, probes: int = 8, *, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, similarity and rank of the k nearest rows of the ``probes`` cells nearest to each query.

    A cell of more than ``block`` rows is searched in parts, and so are its queries, so that no task holds more; only k rows a
    query and part are shuffled to be merged.
    """
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast(centres)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            sizes = np.array(pa.compute.fill_null(pa.compute.list_value_length(b.column(1)), -1))
            fits = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.empty(0, dtype=np.int64)
            if not len(fits):
                continue
            some = b.take(pa.array(fits))
            order = np.argsort(-(_unit(_matrix(some.column(1))) @ c.T), axis=1, kind="stable")[:, :probes]
            many = order.shape[1]
            each = some.take(pa.array(np.repeat(np.arange(len(fits)), many)))
            yield pa.RecordBatch.from_arrays([*each.columns, pa.array(order.ravel().astype(np.int32))], names=["query_id", "embedding", "cell"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(route, "query_id long, embedding array<float>, cell int")
    rows = index.where("cell is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), "cell")
    # a row a cell, of which there are at most MOST_CELLS
    n = rows.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("n"))
    m = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("m"))
    parts = spark.createDataFrame(n.join(m, "cell").collect(), "cell int, n long, m long")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = asked.join(F.broadcast(parts), "cell").select("query_id", "embedding", "cell", F.pmod(F.xxhash64("query_id"), F.col("m")).alias("qb"), every("n").alias("sb"))
    right = rows.join(F.broadcast(parts), "cell").select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("n")).alias("sb"), every("m").alias("qb"))
    wanted = k + 1 if exclude_self else k

    def find(q: pa.Table, s: pa.Table) -> pa.Table:
        if not len(q) or not len(s):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        ids, own = s.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        (at, cols), sim = _best(_matrix(q.column("embedding").combine_chunks()), _matrix(s.column("embedding").combine_chunks()), ids, wanted)
        kept = ids[cols] != own[at] if exclude_self else slice(None)
        return pa.table({"query_id": own[at][kept], "vec_id": ids[cols][kept], "similarity": sim[kept]})

    keys = ["cell", "qb", "sb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, similarity double")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def tune(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int = 3, recall: float = 0.9, sample: int = 200, **options) -> tuple[int, float]:
    """The fewest cells (doubling) that reach ``recall`` on a sample of queries, and the recall measured there."""
    some = queries.orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(sample)
    truth = knn(some, index.where("cell is not null"), k, exclude_self=options.get("exclude_self", False)).persist()
    probes = 1
    while True:
        got = recall_at_k(search(some, index, centres, k, probes, **options), truth, k).agg(F.avg("recall")).first()[0]
        if got is None or got >= recall or probes >= len(centres):
            truth.unpersist()
            return min(probes, max(1, len(centres))), float(got or 0.0)
        probes *= 2
