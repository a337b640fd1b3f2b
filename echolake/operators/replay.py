"""Replaying requests against a cache that fills as they come, round after round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.entities import entity_tokens
from echolake.functions.vectors import EPSILON
from echolake.operators.retrieval import BLOCK, CELLS, DECIMALS, _matrix


def stored_first(nodes: DataFrame, threshold: float, by: list[str], checkpoint, block: int = BLOCK) -> DataFrame:
    """seq and ``stored``: in order of seq, a node is stored unless an earlier stored one that agrees in ``by`` is so similar.

    Nodes have seq (one row each) and embedding.  In rounds, the first ``block`` undecided nodes of every group are decided by one
    task, one after the other against those it has stored; then all others of the group meet what was stored, dealt to parts of
    bounded size, and those that are similar are out.  So no pairs are written, and work is nodes times stored ones.
    ``checkpoint`` stores a table and reads it back.
    """
    group = F.concat_ws("\u0001", F.size("embedding").cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by])
    rows = nodes.where("embedding is not null").select(F.col("seq").cast("long").alias("seq"), F.col("embedding").cast("array<float>").alias("embedding"), group.alias("g"))
    done, left = None, checkpoint(rows)
    while True:
        place = F.row_number().over(Window.partitionBy("g").orderBy("seq"))
        ahead = left.withColumn("place", place).where(F.col("place") <= block).drop("place")
        now = checkpoint(ahead.groupBy("g").applyInArrow(lambda t: _decided(t, threshold), "seq long, embedding array<float>, g string, stored boolean"))
        done = now.select("seq", "stored") if done is None else done.union(now.select("seq", "stored"))
        rest = checkpoint(left.join(now.select("g", "seq"), ["g", "seq"], "left_anti"))
        if rest.isEmpty():
            return done
        # a row a group that has more nodes than one round decides
        parts = checkpoint(rest.groupBy("g").agg(F.ceil(F.count("*") / max(1, block // 4)).alias("parts")))
        dealt = rest.join(parts, "g").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts"))).drop("parts")
        every = now.where("stored").select("embedding", F.col("g").alias("to")).join(parts.withColumnRenamed("g", "to"), "to").select("to", "embedding", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("at"))
        open_ = dealt.groupBy("g", "part").cogroup(every.groupBy("to", "at")).applyInArrow(lambda t, s: _not_like(t, s, threshold), "seq long, embedding array<float>, g string, out boolean")
        met = checkpoint(open_)
        done = done.union(met.where("out").select("seq", F.lit(False).alias("stored")))
        left = met.where("not out").drop("out")


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` are so similar."""
    lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None] + EPSILON
    return np.round(np.clip(x @ y.T / lengths, -1, 1), DECIMALS) >= threshold


def _decided(t: pa.Table, threshold: float) -> pa.Table:
    """The nodes of one group with ``stored``; a few rows at a time meet what is stored and then each other."""
    t = t.sort_by("seq")
    x, stored = _matrix(t.column("embedding").combine_chunks()), np.zeros(len(t), dtype=bool)
    step = max(16, CELLS // max(1, len(x)))
    for i in range(0, len(x), step):
        some = x[i : i + step]
        open_ = np.flatnonzero(~_alike(some, x[:i][stored[:i]], threshold).any(axis=1))
        each = _alike(some[open_], some[open_], threshold)
        kept: list[int] = []
        for k in range(len(open_)):
            if not each[k, kept].any():
                kept.append(k)
        stored[i + open_[kept]] = True
    return t.select(["seq", "embedding", "g"]).append_column("stored", pa.array(stored))


def _not_like(t: pa.Table, stored: pa.Table, threshold: float) -> pa.Table:
    """The nodes of one part with ``out``: whether one of ``stored`` is so similar."""
    out = np.zeros(len(t), dtype=bool)
    if len(t) and len(stored):
        x, y = (_matrix(side.column("embedding").combine_chunks()) for side in (t, stored))
        step = max(1, CELLS // len(y))
        for i in range(0, len(x), step):
            out[i : i + step] = _alike(x[i : i + step], y, threshold).any(axis=1)
    return t.select(["seq", "embedding", "g"]).append_column("out", pa.array(out))


def replay(requests: DataFrame, threshold: float, checkpoint, rounds: int = 2, veto: bool = True) -> DataFrame:
    """round, seq and status (hit, miss, bypass) of every request, sent ``rounds`` times in order of seq to a cache that starts empty.

    ``requests`` has seq, namespace, text, embedding and cacheable.  A miss is stored and answers all later requests of its
    namespace that are similar enough and have the same entities.  Requests of equal namespace and text are one node: but
    for the first they are hits.  What the first round leaves in the cache is what the second one meets.
    """
    rows = requests.withColumn("namespace", F.coalesce("namespace", F.lit("")))
    asked = rows.where(F.col("cacheable") & F.col("embedding").isNotNull())
    nodes = asked.groupBy("namespace", "text").agg(F.min("seq").alias("seq"), F.min_by("embedding", "seq").alias("embedding"))
    # sets of entities are sorted, so equal ones are written alike
    entities = F.to_json(entity_tokens(F.col("text"))) if veto else F.lit("")
    stored = stored_first(nodes.withColumn("entities", entities), threshold, ["namespace", "entities"], checkpoint)
    first = rows.join(stored, "seq", "left").select("seq", F.when(~F.col("cacheable"), "bypass").when(F.col("embedding").isNull(), "miss").when(F.col("stored"), "miss").otherwise("hit").alias("status"))
    # after the first round every cacheable request with a vector finds itself or what answered it
    later = rows.select("seq", F.when(~F.col("cacheable"), "bypass").when(F.col("embedding").isNull(), "miss").otherwise("hit").alias("status"))
    out = first.select(F.lit(1).alias("round"), "seq", "status")
    for r in range(2, rounds + 1):
        out = out.union(later.select(F.lit(r).alias("round"), "seq", "status"))
    return out
