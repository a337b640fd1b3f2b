"""Counters, latencies and costs over an append-only request log.

A log row has ``seq`` columns that order it, ``outcome`` (one of :data:`OUTCOMES`), ``latency_ms``, ``prompt_tokens`` and
``completion_tokens``.  Two latency pools are kept apart: the main one (misses, hits, merges and the time to the first
byte of cacheable streams) and the bypass one (tool calls and other streams).
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.operators.running import positions, running_sums

OUTCOMES = ("miss", "hit", "merge", "bypass", "stream", "stream_hit", "stream_miss", "stream_abort", "stream_no_usage", "cache_write")
RING = 1024

_HITS, _MISSES = ("hit", "stream_hit"), ("miss", "stream_miss")
_MAIN, _BYPASS = ("miss", "hit", "merge", "stream_hit", "stream_miss"), ("bypass", "stream")
_SPENT = ("miss", "bypass", "stream", "stream_miss")


def _is(*outcomes: str) -> Column:
    return F.col("outcome").isin(*outcomes)


def pool() -> Column:
    """``main`` or ``bypass``; null for outcomes without a latency."""
    return F.when(_is(*_MAIN), "main").when(_is(*_BYPASS), "bypass")


def counter_columns() -> list[Column]:
    """The aggregates that :func:`counters` is made of; each adds up, or is a least or a greatest value, over parts of a log."""
    n = lambda *o: F.count_if(_is(*o))
    spent = lambda c: F.coalesce(F.sum(F.when(_is(*_SPENT), F.col(c))), F.lit(0))
    latency = lambda o, f: f(F.when(_is(*o), F.col("latency_ms")))
    return [
        n(*_HITS, *_MISSES).alias("requests"),
        n(*_HITS).alias("hits"),
        n(*_MISSES).alias("misses"),
        n("merge").alias("merged"),
        n("bypass", "stream").alias("bypassed"),
        n("stream", "stream_hit", "stream_miss").alias("streams"),
        n("stream_hit").alias("stream_hits"),
        n("stream_abort").alias("streams_aborted"),
        n("stream_no_usage").alias("streams_without_usage"),
        n("cache_write").alias("cache_writes"),
        spent("prompt_tokens").alias("prompt_tokens"),
        spent("completion_tokens").alias("completion_tokens"),
        F.coalesce(latency(_MAIN, F.sum), F.lit(0)).alias("_sum"),
        n(*_MAIN).alias("_n"),
        latency(_MAIN, F.min).alias("min_latency_ms"),
        latency(_MAIN, F.max).alias("max_latency_ms"),
        F.coalesce(latency(_BYPASS, F.sum), F.lit(0)).alias("_bypass_sum"),
        n(*_BYPASS).alias("_bypass_n"),
    ]


def counters(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """All counters in one aggregation."""
    return finished(log.groupBy(*by).agg(*counter_columns()))


def finished(sums: DataFrame) -> DataFrame:
    """Rates and means from the aggregates of :func:`counter_columns`."""
    return sums.withColumns(
        {
            "hit_rate": F.coalesce(F.try_divide("hits", "requests"), F.lit(0.0)),
            "avg_latency_ms": F.expr("if(_n = 0, 0, _sum div _n)"),
            "bypass_avg_latency_ms": F.expr("if(_bypass_n = 0, 0, _bypass_sum div _bypass_n)"),
        }
    ).drop("_sum", "_n", "_bypass_sum", "_bypass_n")


def cost(prompt: Column, completion: Column, prompt_price: float, completion_price: float) -> Column:
    """Prices are for 1,000 tokens."""
    return prompt * prompt_price / 1000.0 + completion * completion_price / 1000.0


def tokens_saved(log: DataFrame, order: list[str]) -> DataFrame:
    """Every hit with what it is estimated to save: all tokens spent so far by the misses so far, in whole numbers.

    The split in prompt and completion tokens divides each on its own, and before the first miss nothing is saved.
    """
    spent = _is(*_SPENT)
    run = running_sums(
        log,
        order,
        {
            "_prompt": F.when(spent, F.col("prompt_tokens")).otherwise(0),
            "_completion": F.when(spent, F.col("completion_tokens")).otherwise(0),
            "_misses": F.when(_is(*_MISSES), 1).otherwise(0),
        },
    )
    div = lambda what: F.expr(f"if(_misses = 0, 0, ({what}) div _misses)")
    return run.where(_is(*_HITS)).withColumns({"saved": div("_prompt + _completion"), "saved_prompt": div("_prompt"), "saved_completion": div("_completion")}).drop("_prompt", "_completion", "_misses")


def ring(log: DataFrame, order: list[str], size: int = RING) -> DataFrame:
    """The last ``size`` latencies of either pool; the limit is applied in every task before the shuffle."""
    last = Window.partitionBy("pool").orderBy(*[F.desc(c) for c in order])
    return log.withColumn("pool", pool()).where("pool is not null").withColumn("place", F.row_number().over(last)).where(F.col("place") <= size)


#: Rows that one task slides its window over, beside those before them that it needs.
STRETCH = 16_384


def running_ring(log: DataFrame, order: list[str], ps: list[float], size: int = RING) -> DataFrame:
    """Every row that has a latency with its ``pool`` and the percentiles p<P> of the last ``size`` latencies of the pool up to this row.

    A pool's rows are numbered and cut into stretches; a stretch also gets the last ``size`` - 1 rows before it, so that
    stretches of one pool are worked on side by side.  A task keeps the window's latencies sorted as it slides.
    """
    columns = [*order, "pool", "latency_ms"]
    rows = log.withColumn("pool", pool()).where("pool is not null and latency_ms is not null").select(*dict.fromkeys(columns))
    placed = positions(rows, ["pool"], order, "_at")
    stretch = max(STRETCH, size)
    own = F.expr(f"_at div {stretch}")
    wanted = F.when(F.col("_at") % stretch > stretch - size, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = placed.withColumn("_stretch", F.explode(wanted))
    names, schema = rows.columns, rows.withColumns({f"p{p:g}": F.col("latency_ms") for p in ps}).schema

    def slide(t: pa.Table) -> pa.Table:
        t = t.sort_by("_at")
        at, x = t.column("_at").to_numpy(), t.column("latency_ms").to_pylist()
        first = int(t.column("_stretch")[0].as_py()) * stretch
        held: list = []
        out: list[list] = [[] for _ in ps]
        for i, value in enumerate(x):
            if i >= size:
                del held[bisect.bisect_left(held, x[i - size])]
            bisect.insort(held, value)
            if at[i] >= first:
                for o, p in zip(out, ps):
                    o.append(held[int(p / 100.0 * (len(held) - 1))])
        own = t.slice(int(np.searchsorted(at, first)))
        return pa.table({c: own.column(c) for c in names} | {f"p{p:g}": pa.array(o, own.schema.field("latency_ms").type) for p, o in zip(ps, out)})

    return dealt.groupBy("pool", "_stretch").applyInArrow(slide, schema)


def rank_floor(p: float, n: Column) -> Column:
    """Index of a percentile in n sorted values: floor(p/100 * (n-1))."""
    return F.floor(F.lit(p / 100.0) * (n - 1))


def rank_scaled(p: float, n: Column) -> Column:
    """The other convention: floor(n*p/100), at most n-1."""
    return F.least(F.floor(n * F.lit(p / 100.0)), n - 1)


def percentiles(df: DataFrame, value: str, by: list[str], ps: list[float], rank=rank_floor) -> DataFrame:
    """Exact percentiles p<P> per group and the count ``samples``, for groups of any size.

    Equal values are counted first; then distinct values are sorted by ranges of group and value, so that a group of however many
    values is several tasks' work.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_x")).agg(F.count("*").alias("_c"))
    run = running_sums(counted, [*by, "_x"], {"_run": F.col("_c")})
    # a row a group: how many rows it has, and how many come before it
    totals = run.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.sum("_c").alias("samples"), F.min(F.col("_run") - F.col("_c")).alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    joined = run.join(totals, same) if by else run.crossJoin(F.broadcast(totals))  # one row
    upto = F.col("_run") - F.col("_before")
    return joined.groupBy(*by, "samples").agg(*[F.min(F.when(upto > rank(p, F.col("samples")), F.col("_x"))).alias(f"p{p:g}") for p in ps])


def ghost_rate(searches: DataFrame, by: list[str] = ()) -> DataFrame:
    """``searches`` has ``is_ghost``: the nearest vector's entry was gone.  Whole per cent, and whether a rebuild is due."""
    got = searches.groupBy(*by).agg(F.count_if("is_ghost").alias("ghosts"), F.count("*").alias("searches"))
    return got.withColumn("ghost_percent", F.expr("if(searches = 0, 0, ghosts * 100 div searches)")).withColumn("rebuild", F.expr("searches >= 10 and ghosts * 100 > 5 * searches"))


def sampled_log(log: DataFrame, seq: str, n: int) -> DataFrame:
    """One row of ``n``, by number."""
    return log.where(F.col(seq) % n == 0)
