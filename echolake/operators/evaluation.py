"""Match quality, replay and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.operators.metrics import percentiles, rank_scaled

# The thresholds that are compared.
THRESHOLDS = (0.80, 0.85, 0.88, 0.90, 0.92, 0.95, 0.98)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(pairs: DataFrame, by: list[str] = (), similarity: str = "similarity", truth: str = "is_match", vetoed: Column | None = None, threshold: Column | None = None) -> DataFrame:
    """Counts and rates of predicting a match where the similarity reaches the threshold and nothing vetoes it."""
    veto = F.coalesce(vetoed, F.lit(False)) if vetoed is not None else F.lit(False)
    near = F.col(similarity) >= (threshold if threshold is not None else F.col("threshold"))
    return _matrix(pairs, by, near, veto, F.col(truth), F.lit(1))


def _matrix(rows: DataFrame, by: list[str], near: Column, veto: Column, match: Column, n: Column) -> DataFrame:
    """The counts of rows that stand for ``n`` pairs each, and the rates that follow."""
    hit = near & ~veto
    of = lambda condition: F.coalesce(F.sum(F.when(condition, n)), F.lit(0))
    got = rows.groupBy(*by).agg(
        of(hit & match).alias("tp"),
        of(hit & ~match).alias("fp"),
        of(~hit & ~match).alias("tn"),
        of(~hit & match).alias("fn"),
        of(near & veto & match).alias("vetoed_match"),
        of(near & veto & ~match).alias("vetoed_other"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return got.withColumns(
        {
            "recall": _ratio(tp, tp + fn),
            "false_hit_rate": _ratio(fp, fp + tn),
            "precision": _ratio(tp, tp + fp),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
            "accuracy": _ratio(tp + tn, tp + fp + tn + fn),
        }
    )


def sweep(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, by: list[str] = (), similarity: str = "similarity", truth: str = "is_match", vetoed: Column | None = None, both: bool = False) -> DataFrame:
    """:func:`confusion` for every threshold, in one pass over the pairs; with ``both`` also without the veto (column ``veto``).

    Pairs are counted by how many thresholds they reach; what a threshold accepts is what reaches it and all below it, so the
    matrix at every threshold is a sum over these few counts.
    """
    cuts = sorted(set(thresholds))
    reached = sum(((F.col(similarity) >= c).cast("int") for c in cuts), F.lit(0))
    veto = F.coalesce(vetoed, F.lit(False)) if vetoed is not None else F.lit(False)
    counts = pairs.groupBy(*by, reached.alias("_reached"), F.col(truth).alias("_match"), veto.alias("_veto")).agg(F.count("*").alias("_n"))
    each = counts.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(k).alias("k")) for k, c in enumerate(cuts)]))).withColumn("threshold", F.col("_t.threshold"))
    if both:
        each = each.withColumn("veto", F.explode(F.array(F.lit(False), F.lit(True))))
    applied = F.col("_veto") & F.col("veto") if both else F.col("_veto")
    return _matrix(each, [*by, *(["veto"] if both else []), "threshold"], F.col("_reached") > F.col("_t.k"), applied, F.col("_match"), F.col("_n"))


def replay_report(log: DataFrame) -> DataFrame:
    """Per round and for all (null round): requests by status, hit rate over hits and misses, latencies by status.

    ``log`` has round, status and latency_ms.
    """
    got = log.rollup("round").agg(
        F.count("*").alias("requests"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("hit", "miss", "merged", "bypass", "error")],
        *[F.avg(F.when(F.col("status") == s, F.col("latency_ms"))).alias(f"avg_{s}_ms") for s in ("hit", "miss")],
    )
    return got.withColumn("hit_rate", _ratio(F.col("n_hit"), F.col("n_hit") + F.col("n_miss")))


def load_report(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Successes, failures, mean latency of successes, and requests a second between first and last start."""
    got = log.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.avg(F.when(F.col("ok"), F.col("latency_ms"))).alias("avg_latency_ms"),
        (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("_span"),
    )
    return got.withColumn("per_second", F.coalesce(F.try_divide(F.col("requests") * 1e6, F.col("_span")), F.lit(0.0))).drop("_span")


def latency_report(log: DataFrame, by: list[str]) -> DataFrame:
    """Percentiles by the scaled rank, as load tools take them."""
    return percentiles(log, "latency_ms", by, [50, 95, 99], rank_scaled)


def status_histogram(log: DataFrame, status: str = "status") -> DataFrame:
    return log.groupBy(status).agg(F.count("*").alias("n"))


def recall_report(per_query: DataFrame, found: DataFrame) -> DataFrame:
    """Mean recall, how often a query's own row is its first, and how many queries found nothing."""
    first = found.where("rank = 1").select("query_id", (F.col("vec_id") == F.col("query_id")).alias("self_first"))
    both = per_query.join(first, "query_id", "left")
    return both.agg(F.avg("recall").alias("mean_recall"), F.avg(F.coalesce(F.col("self_first"), F.lit(False)).cast("double")).alias("self_first_rate"), F.count_if(F.col("self_first").isNull()).alias("empty"))


def stride_ids(n: int, q: int) -> list[int]:
    """``q`` row numbers of ``n``, evenly spaced."""
    return [i * n // q for i in range(min(n, q))]


def stride_sample(df: DataFrame, number: str, n: int, q: int) -> DataFrame:
    """Rows whose number is one of :func:`stride_ids`; an expression, so no list is shipped."""
    i = F.ceil(F.col(number) * q / n)
    return df.where((F.floor(i * n / q) == F.col(number)) & (i < q))
