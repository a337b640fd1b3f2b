"""Nearest-neighbour retrieval and what follows it: threshold, namespace, entity veto, lookup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.entities import entity_mismatch, entity_tokens
from echolake.functions.keys import in_namespace, same_namespace
from echolake.functions.vectors import EPSILON, cosine

BLOCK = 16_384
CELLS = 1 << 20  # similarities that a task holds at once
DECIMALS = 6  # similarities are compared and shown rounded, so that ties do not depend on the order of additions


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))


def _best(queries: np.ndarray, store: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places of its k most similar rows of ``store``, and the similarities; of :data:`CELLS` pairs at a time."""
    lengths, own = np.linalg.norm(store, axis=1)[None], np.linalg.norm(queries, axis=1)[:, None]
    step = max(1, CELLS // max(1, len(store)))
    found = [(np.empty((2, 0), dtype=np.int64), np.empty(0))]
    for i in range(0, len(queries), step):
        far = queries[i : i + step] @ store.T  # becomes the similarity with its sign turned
        far /= -(own[i : i + step] * lengths + EPSILON)
        if len(ids) > k:  # all rows that are as good as the k-th when rounded stay, so that ties are settled by id
            rows, cols = np.nonzero(far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k] + 2 * 10.0**-DECIMALS)
        else:
            rows, cols = np.nonzero(np.ones_like(far, dtype=bool))
        sim = np.round(np.clip(-far[rows, cols], -1, 1), DECIMALS)
        order = np.lexsort((ids[cols], -sim, rows))
        rows, cols, sim = rows[order], cols[order], sim[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        found.append((np.stack([rows[kept] + i, cols[kept]]), sim[kept]))
    return np.concatenate([at for at, _ in found], axis=1), np.concatenate([sim for _, sim in found])


def knn(queries: DataFrame, store: DataFrame, k: int = 3, *, partition_by: list[str] = (), exclude_self: bool = False, block: int = BLOCK, blocks: int | None = None) -> DataFrame:
    """query_id, vec_id, similarity and rank of the exact k nearest rows of ``store`` for every row of ``queries``.

    Both frames have ``embedding`` (array<float>); queries have ``query_id``, the store ``vec_id``, and both have the
    columns of ``partition_by``, in which rows must agree (a pre-filter by namespace).  Store rows are dealt to blocks
    of bounded size and queries to blocks as well; each pair of blocks is one matrix product, and only k rows a query
    and block are shuffled to be merged.  Vectors of another length than the query's do not match.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in partition_by]
    group = F.concat_ws("\u0001", F.lit(""), *part)
    left = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"), group.alias("g"), F.size("embedding").alias("dim"))
    right = store.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), group.alias("g"), F.size("embedding").alias("dim"))
    spark = queries.sparkSession
    # both counts in one job, of one row each
    asked, held = left.agg(F.count("*").alias("asked")).crossJoin(right.agg(F.count("*").alias("held"))).first()
    n = blocks or max(-(-held // block), spark.sparkContext.defaultParallelism)
    m = max(1, -(-asked // block))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    left = left.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(m))).withColumn("sb", every(n))
    right = right.withColumn("sb", F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn("qb", every(m))
    wanted = k + 1 if exclude_self else k

    def search(q: pa.Table, s: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())}
        if not len(q) or not len(s):
            return pa.table(empty)
        ids, own = s.column("vec_id").to_numpy(), q.column("query_id").to_numpy()
        (rows, cols), sim = _best(_matrix(q.column("embedding").combine_chunks()), _matrix(s.column("embedding").combine_chunks()), ids, wanted)
        kept = ids[cols] != own[rows] if exclude_self else slice(None)
        return pa.table({"query_id": own[rows][kept], "vec_id": ids[cols][kept], "similarity": sim[kept]})

    keys = ["g", "dim", "qb", "sb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, similarity double")
    return top_k(found, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def knn_expression(queries: DataFrame, store: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """The same in column expressions: readable, and slower; for small inputs and as a reference."""
    q = queries.select("query_id", F.col("embedding").alias("q_embedding"))
    s = store.select("vec_id", F.col("embedding").alias("s_embedding"))
    pairs = q.join(s, (F.size("q_embedding") == F.size("s_embedding")) & (F.lit(not exclude_self) | (F.col("query_id") != F.col("vec_id"))))
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("q_embedding"), F.col("s_embedding")), DECIMALS).alias("similarity"))
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of every group, with ``rank`` from 1; the limit is applied before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def judge(candidates: DataFrame, queries: DataFrame, store: DataFrame, *, threshold: float = 0.85, namespaces: str = "post", veto: bool = True) -> DataFrame:
    """For every query the first candidate that survives, or none.

    ``candidates`` come from :func:`knn`; ``queries`` have query_id, namespace and text, ``store`` has vec_id, key,
    source and value (live entries only).  ``namespaces``: ``post`` tests the key's prefix and lets a query without a
    namespace match any, ``symmetric`` keeps such a query to keys without one.
    Entities are extracted once a row, and of the store for candidates over the threshold only.
    """
    test = {"post": in_namespace, "symmetric": same_namespace}[namespaces]
    q = queries.select("query_id", "namespace", entity_tokens(F.col("text")).alias("q_entities"))
    near = candidates.where(F.col("similarity") >= threshold)
    wanted = store.select("vec_id", "key", "value", "source").join(near.select("vec_id").distinct(), "vec_id", "left_semi")
    s = wanted.select("vec_id", "key", "value", entity_tokens(F.regexp_replace("source", r"^ns[0-9a-f]{16}:", "")).alias("s_entities"))
    kept = near.join(q, "query_id").join(s, "vec_id").where(test(F.col("key"), F.col("namespace")))
    if veto:
        kept = kept.where(~entity_mismatch(F.col("q_entities"), F.col("s_entities")))
    first = kept.groupBy("query_id").agg(F.min_by(F.struct("vec_id", "key", "value", "similarity"), "rank").alias("hit"))
    return queries.select("query_id").join(first, "query_id", "left").select("query_id", F.col("hit").isNotNull().alias("is_hit"), "hit.vec_id", "hit.key", "hit.value", "hit.similarity")


def exact_lookup(queries: DataFrame, store: DataFrame, lookup: str = "lookup") -> DataFrame:
    """Per query the most recently used entry whose key or source is the looked-up text.

    ``store`` has key, source, value and ``recency`` (higher: later).  Two equi-joins in place of an OR; before them the newest entry
    of every key and of every source is picked, so that a source of many entries gives one row, and those that look it up one each.
    """
    q = queries.select("query_id", F.col(lookup).alias("x"))
    entry = F.struct("recency", "key", "value").alias("entry")
    by_key = store.where("key is not null").groupBy(F.col("key").alias("x")).agg(F.max(entry).alias("entry"))
    by_source = store.where("source is not null").groupBy(F.col("source").alias("x")).agg(F.max(entry).alias("entry"))
    newest = by_key.unionByName(by_source).groupBy("x").agg(F.max("entry").alias("hit"))
    return q.join(newest, "x", "left").select("query_id", F.col("x").alias(lookup), "hit.key", "hit.value")


def missing_from(store: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """Entries that an index does not hold yet."""
    return store.join(index.select(key), key, "left_anti")


def key_differences(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Keys that one table has more often than the other, and which: ``a`` or ``b``; a row for each surplus one."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("only", F.lit("a")).unionByName(y.exceptAll(x).withColumn("only", F.lit("b")))


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query the share of the true k nearest that were found; both frames have query_id, vec_id and rank."""
    t = truth.where(F.col("rank") <= k)
    hits = t.join(found.where(F.col("rank") <= k).select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def recall_with_ties(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query of ``truth`` the share of its k nearest that were found, any vector as similar as the k-th being one of them, and
    whether the ``first`` found is as similar as the true one; both frames have query_id, similarity and rank."""
    near = truth.where(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"), F.max("similarity").alias("most"))
    met = near.join(found.where(F.col("rank") <= k).select("query_id", F.col("similarity").alias("s")), "query_id", "left")
    as_good = lambda c: F.col("s") >= F.col(c) - 2 * 10.0**-DECIMALS
    return met.groupBy("query_id").agg(F.least(F.lit(1.0), F.count_if(as_good("least")) / F.first("n")).alias("recall"), F.coalesce(F.bool_or(as_good("most")), F.lit(False)).alias("first"))
