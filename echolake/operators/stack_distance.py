"""Reuse distances of an access log, which give the hit rate of an LRU cache at every capacity at once.

The distance of an access is the number of distinct keys accessed since the last access of its own key; a cache of C entries hits it if
that is below C.  With positions over the whole log in order, and p the position of the last access of the same key, the
distinct keys since are the accesses j after p and before i that are the first of their key since p: those whose own last access is
p or earlier.  All up to p are of that kind too, so the distance is the number of j < i with last(j) <= p, less p.

Counting these is divide and conquer over positions.  At each level the log is cut into pairs of neighbouring ranges, and
every access of a right range counts those of its left range by the order of last accesses: a running count over a sort by
pair and last access.  Levels of large ranges are distributed sorts; when a range is small enough, a task counts within it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.operators.running import running_sums
from echolake.storage import checkpointed

RANGE_BITS = 17  # a task counts within 131,072 accesses


def _counted(last: np.ndarray) -> np.ndarray:
    """For each place the number of earlier places with a last access not after its own."""
    n = len(last)
    out, place = np.zeros(n, dtype=np.int64), np.arange(n)
    for bit in range(max(0, n - 1).bit_length()):
        pair, right = place >> (bit + 1), (place >> bit) & 1
        order = np.lexsort((right, last, pair))  # of equal last accesses the left ones first
        left = np.cumsum(1 - right[order])
        begins = np.searchsorted(pair[order], pair[order], side="left")
        before = np.concatenate([[0], left])[begins]
        out[order] += np.where(right[order] == 1, left - before, 0)
    return out


def distances(accesses: DataFrame, by: list[str], order: list[str], key: str = "key", bits: int = RANGE_BITS) -> DataFrame:
    """``accesses`` with ``distance``, null for the first access of a key; a cache is what agrees in ``by``.

    Rows are ordered by ``order`` in each cache; one cache's log may be of any length, and so may one key's.
    """
    columns = accesses.columns
    placed = running_sums(accesses, [*by, *order], {"_i": F.lit(1)})
    # the last access of the same key, by a sort of keys in which a hot key is cut by its positions
    linked = running_last(placed, [*by, key], "_i")
    rows = checkpointed(linked)
    total = rows.count()
    most = max(0, total - 1).bit_length()
    need = rows.select((F.col("_i") - 1).alias("at"), F.coalesce("_last", F.lit(0)).alias("last"))
    counts = _inside(need, bits)
    for bit in range(bits, most):
        pair, right = F.shiftright("at", bit + 1), F.shiftright("at", bit).bitwiseAND(F.lit(1))
        level = need.select("at", "last", pair.alias("pair"), right.alias("right"))
        run = running_sums(level, ["pair", "last", "right"], {"left": 1 - F.col("right")})
        # every pair but the last has a full left range
        before = F.col("pair") * (1 << bit)
        counts = counts.unionByName(run.where("right = 1").select("at", (F.col("left") - before).alias("n")))
    summed = counts.groupBy("at").agg(F.sum("n").alias("n")).withColumnRenamed("at", "_at")
    joined = rows.join(summed, F.col("_i") - 1 == F.col("_at"))
    return joined.select(*columns, F.when(F.col("_last").isNotNull(), F.col("n") - F.col("_last")).alias("distance"))


def running_last(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """``df`` with ``_last``, the ``position`` of the row before in its group: rows are numbered in a sort by group and position,
    and each meets the one numbered before it."""
    numbered = running_sums(df, [*by, position], {"_k": F.lit(1)})
    same = [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)]
    before = numbered.select((F.col("_k") + 1).alias("_n"), F.col(position).alias("_p"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)])
    joined = numbered.join(before, F.col("_k") == F.col("_n"), "left")
    agrees = F.lit(True)
    for s in same:
        agrees = agrees & s
    return joined.select(*df.columns, F.when(agrees, F.col("_p")).alias("_last"))


def _inside(need: DataFrame, bits: int) -> DataFrame:
    """Counts within ranges of 2**bits positions."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"at": t.column("at"), "n": pa.array(_counted(t.column("last").to_numpy()))})

    return need.withColumn("range", F.shiftright("at", bits)).groupBy("range").applyInArrow(run, "at long, n long")


def miss_ratio_curve(accesses: DataFrame, by: list[str], order: list[str], key: str = "key", bits: int = RANGE_BITS) -> DataFrame:
    """Per cache and capacity, at every capacity that hits more than the one below: hits, accesses and miss_ratio."""
    d = distances(accesses, by, order, key, bits)
    counted = d.groupBy(*by, "distance").agg(F.count("*").alias("n"))
    totals = counted.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.sum("n").alias("accesses"))
    run = running_sums(counted.where("distance is not null"), [*by, "distance"], {"_run": F.col("n")})
    starts = run.groupBy(*[F.col(c).alias(f"_h{k}") for k, c in enumerate(by)]).agg(F.min(F.col("_run") - F.col("n")).alias("_before"))
    first = [F.col(c).eqNullSafe(F.col(f"_h{k}")) for k, c in enumerate(by)]
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    joined = (run.join(starts, first).join(totals, same)) if by else run.crossJoin(F.broadcast(starts)).crossJoin(F.broadcast(totals))  # one row each
    hits = F.col("_run") - F.col("_before")
    return joined.select(*by, (F.col("distance") + 1).alias("capacity"), hits.alias("hits"), "accesses", (1 - hits / F.col("accesses")).alias("miss_ratio"))
