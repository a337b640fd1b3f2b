"""Metrics as text: an exposition format for scrapers, and a one-line summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: metric, type, column, help; ratios and prices are gauges.
METRICS = (
    ("requests_total", "counter", "requests", "Cacheable requests: hits and misses."),
    ("cache_hits_total", "counter", "hits", "Requests answered from the cache."),
    ("cache_misses_total", "counter", "misses", "Requests sent upstream."),
    ("cache_hit_ratio", "gauge", "hit_rate", "Hits by requests."),
    ("cache_bypassed_total", "counter", "bypassed", "Requests that are never cached."),
    ("cache_merged_total", "counter", "merged", "Requests that joined one in flight."),
    ("tokens_prompt_total", "counter", "prompt_tokens", "Prompt tokens spent upstream."),
    ("tokens_completion_total", "counter", "completion_tokens", "Completion tokens spent upstream."),
    ("tokens_saved_total", "counter", "tokens_saved", "Tokens that hits are estimated to save."),
    ("cost_total", "counter", "cost", "Estimated cost."),
    ("cost_saved_total", "counter", "cost_saved", "Estimated cost that hits save."),
    ("price_input_per_1k", "gauge", "input_per_1k", "Price of 1,000 prompt tokens."),
    ("price_output_per_1k", "gauge", "output_per_1k", "Price of 1,000 completion tokens."),
    ("latency_avg_milliseconds", "gauge", "avg_latency_ms", "Mean latency of the main pool."),
    ("latency_min_milliseconds", "gauge", "min_latency_ms", "Least latency of the main pool."),
    ("latency_max_milliseconds", "gauge", "max_latency_ms", "Greatest latency of the main pool."),
    ("latency_milliseconds{quantile=\"0.5\"}", "gauge", "p50", "Latency of the main pool's last requests."),
    ("latency_milliseconds{quantile=\"0.95\"}", "gauge", "p95", "Latency of the main pool's last requests."),
    ("latency_milliseconds{quantile=\"0.99\"}", "gauge", "p99", "Latency of the main pool's last requests."),
    ("latency_samples", "gauge", "samples", "Requests in the main pool's window."),
    ("bypass_latency_avg_milliseconds", "gauge", "bypass_avg_latency_ms", "Mean latency of the bypass pool."),
    ("bypass_latency_milliseconds{quantile=\"0.5\"}", "gauge", "bypass_p50", "Latency of the bypass pool's last requests."),
    ("bypass_latency_milliseconds{quantile=\"0.95\"}", "gauge", "bypass_p95", "Latency of the bypass pool's last requests."),
    ("bypass_latency_samples", "gauge", "bypass_samples", "Requests in the bypass pool's window."),
    ("streams_total", "counter", "streams", "Streams that ended, whole or not."),
    ("streams_aborted_total", "counter", "streams_aborted", "Streams that ended early."),
    ("streams_without_usage_total", "counter", "streams_without_usage", "Whole streams without usage."),
    ("stream_cache_hits_total", "counter", "stream_hits", "Streams replayed from the cache."),
    ("cache_writes_total", "counter", "cache_writes", "Entries written."),
    ("index_ready", "gauge", "index_ready", "Whether the index answers searches."),
    ("index_building", "gauge", "index_building", "Whether an index is being built."),
    ("index_vectors", "gauge", "index_vectors", "Vectors in the index."),
    ("cache_degraded_searches_total", "counter", "degraded_searches", "Searches without the index."),
    ("uptime_seconds", "gauge", "uptime_seconds", "Seconds since the start."),
)
#: Left out where negative: not measured.
OPTIONAL = frozenset({"index_ready", "index_building", "index_vectors", "degraded_searches", "uptime_seconds"})


def format_number(v: Column) -> Column:
    """Whole numbers without a point, others with six decimals."""
    d = v.cast("double")
    return F.when(d == F.floor(d), F.floor(d).cast("string")).otherwise(F.format_string("%.6f", d))


def exposition(snapshot: DataFrame, prefix: str = "cache") -> DataFrame:
    """``place`` and ``line``: help and type lines before the first sample of each metric, once per name, then the samples.

    ``snapshot`` has one row; columns it lacks, and optional ones that are negative, are left out.
    """
    known = [x for x in METRICS if x[2] in snapshot.columns]
    cells = []
    for k, (m, t, c, help_) in enumerate(known):
        name = m.split("{")[0]
        value = F.col(c).cast("double")
        if c in OPTIONAL:
            value = F.when(value >= 0, value)
        new = all(o.split("{")[0] != name for o, *_ in known[:k])
        cells.append(F.struct(F.lit(k).alias("k"), F.lit(f"# HELP {prefix}_{name} {help_}" if new else None).cast("string").alias("help"), F.lit(f"# TYPE {prefix}_{name} {t}" if new else None).cast("string").alias("head"), F.lit(f"{prefix}_{m}").alias("metric"), value.alias("value")))
    rows = snapshot.select(F.explode(F.array(*cells)).alias("m")).select("m.*").where("value is not null")
    lines = F.array(F.struct((F.col("k") * 3).alias("place"), F.col("help").alias("line")), F.struct((F.col("k") * 3 + 1).alias("place"), F.col("head").alias("line")), F.struct((F.col("k") * 3 + 2).alias("place"), F.concat_ws(" ", "metric", format_number(F.col("value"))).alias("line")))
    return rows.select(F.explode(lines).alias("l")).select("l.place", "l.line").where("line is not null")


def write_exposition(snapshot: DataFrame, path: str, prefix: str = "cache") -> None:
    """A snapshot is one row, so its few lines make one file."""
    exposition(snapshot, prefix).orderBy("place").coalesce(1).select("line").write.mode("overwrite").text(path)


def summary(snapshot: DataFrame) -> DataFrame:
    """One line for the log; none where nothing happened."""
    busy = F.col("requests") + F.col("bypassed") + F.col("merged") + F.col("streams") > 0
    line = F.format_string(
        "requests=%d hits=%d misses=%d hit_rate=%.1f%% merged=%d bypassed=%d streams=%d avg_ms=%d prompt_tokens=%d completion_tokens=%d",
        "requests", "hits", "misses", F.col("hit_rate") * 100, "merged", "bypassed", "streams", "avg_latency_ms", "prompt_tokens", "completion_tokens",
    )
    return snapshot.where(busy).select(line.alias("line"))
