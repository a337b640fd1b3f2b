"""The life of requests as one lineage of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.config import Config
from echolake.functions.entities import entity_mismatch, entity_tokens
from echolake.functions.keys import lookup_key
from echolake.functions.requests import cacheable, classify, upstream_status
from echolake.functions.screen import screen_input, screen_output
from echolake.functions.sse import content, fill_eligible, has_done, replay, usage
from echolake.functions.vectors import cosine_batch
from echolake.operators import evaluation, retrieval
from echolake.operators.cache_table import live, rebuild


def prepare(requests: DataFrame, config: Config, embed) -> DataFrame:
    """request_id and body, classified and screened, with the text that is looked up and its vector.

    Where input is cut, only the user's text is.  The vector is computed once; keep the result if it is used twice.
    """
    f = config.filter
    rows = classify(requests).withColumn("screen", screen_input(F.col("all_text"), block_urls=f.block_urls, keywords=f.blocked_keywords, max_bytes=f.max_input_bytes))
    rows = rows.withColumn("text", F.when(F.col("screen.action") == "truncate", screen_input(F.col("user_text"), max_bytes=f.max_input_bytes)["sanitized"]).otherwise(F.col("user_text")))
    can = (F.col("screen.action") != "reject") & cacheable(F.lit(config.cache.enabled), F.col("is_tool"), F.col("text"))
    return rows.withColumn("cacheable", can).withColumn("embedding", F.when(F.col("cacheable"), embed(F.col("text"))))


def serve(requests: DataFrame, entries: DataFrame, replies: DataFrame, config: Config, embed, now: int) -> DataFrame:
    """request_id, status, http_status and reply of every request against one version of the entries.

    ``entries`` has vec_id besides the columns of the cache table; ``replies`` (request_id, status, reply, and timed_out
    if known) is what the upstream would answer.  Lookups without a vector fall back to the exact text.
    """
    q = prepare(requests, config, embed).withColumnRenamed("request_id", "query_id")
    store = live(entries, now, config.cache.ttl_seconds)
    asked = q.where("cacheable")
    near = retrieval.knn(asked.where("embedding is not null"), store, config.cache.top_k)
    hits = retrieval.judge(near, asked.select("query_id", "namespace", "text"), store, threshold=config.cache.threshold, veto=config.cache.veto).where("is_hit").select("query_id", F.col("value").alias("semantic"))
    exact = retrieval.exact_lookup(asked.where("embedding is null").select("query_id", lookup_key(F.col("namespace"), F.col("text")).alias("lookup")), store.withColumn("recency", F.col("last_access"))).where("value is not null").select("query_id", F.col("value").alias("exact"))
    timed_out = F.col("timed_out") if "timed_out" in replies.columns else None
    up = replies.select(F.col("request_id").alias("query_id"), upstream_status(F.col("status"), timed_out).alias("up_status"), "reply")
    all_ = q.select("query_id", "screen", "is_tool", "cacheable").join(hits, "query_id", "left").join(exact, "query_id", "left").join(up, "query_id", "left")
    hit = F.coalesce("semantic", "exact")
    status = F.when(F.col("screen.action") == "reject", "rejected").when(F.col("is_tool"), "bypass").when(hit.isNotNull(), "hit").otherwise("miss")
    out = all_.withColumn("status", status).withColumn("reply", F.when(F.col("status") == "rejected", F.col("screen.reason")).when(F.col("status") == "hit", hit).otherwise(F.col("reply")))
    out = out.withColumn("out", screen_output(F.col("reply"), block_urls=config.filter.block_urls, max_bytes=config.filter.max_output_bytes))
    bad = (F.col("status") != "rejected") & (F.col("out.action") == "reject")
    code = F.when(F.col("status") == "rejected", 400).when(bad, 502).when(F.col("status") == "hit", 200).otherwise(F.coalesce("up_status", F.lit(502)))
    return out.select(F.col("query_id").alias("request_id"), "status", code.alias("http_status"), F.when(bad, F.col("out.reason")).when(F.col("status") == "rejected", F.col("reply")).otherwise(F.col("out.sanitized")).alias("reply"))


def relay(streams: DataFrame) -> DataFrame:
    """Finished streams (stream_id, sse, aborted) with their text, usage, and whether they may fill the cache."""
    text = content(F.col("sse"))
    return streams.withColumn("text", text).withColumn("usage", usage(F.col("sse"))).withColumn("fills", fill_eligible(F.octet_length("sse"), F.col("text"), has_done(F.col("sse")), F.col("aborted")))


def replay_hits(hits: DataFrame) -> DataFrame:
    """Stored streams as they are sent again: screened as a whole before the first byte."""
    checked = hits.withColumn("screen", screen_output(F.col("sse"), block_urls=True))
    return checked.select("stream_id", F.when(F.col("screen.action") == "reject", 502).otherwise(200).alias("http_status"), F.when(F.col("screen.action") != "reject", replay(F.col("sse"))).alias("sent"))


def maintain(entries: DataFrame, embed, now: int, config: Config) -> DataFrame:
    """The next version of the entries after purging and encoding again what lacks a vector."""
    return rebuild(entries, embed, now, config.cache.ttl_seconds, config.embedding.dim)


def evaluate_pairs(pairs: DataFrame, embed, thresholds=evaluation.THRESHOLDS, setting: str = "default") -> DataFrame:
    """Match quality at every threshold, without and with the entity veto, for labelled pairs of sentences."""
    scored = pairs.withColumns({"a": embed(F.col("sentence1")), "b": embed(F.col("sentence2"))})
    scored = scored.withColumn("similarity", cosine_batch(F.col("a"), F.col("b"))).withColumn("differs", entity_mismatch(entity_tokens(F.col("sentence1")), entity_tokens(F.col("sentence2"))))
    both = scored.select("is_match", "similarity", "differs", F.explode(F.array(F.lit(False), F.lit(True))).alias("veto"))
    return evaluation.sweep(both, thresholds, ["veto"], vetoed=F.col("veto") & F.col("differs")).withColumn("setting", F.lit(setting))


def compare_settings(pairs: DataFrame, embedders: dict[tuple[str, str], object], threshold: float = 0.80) -> DataFrame:
    """Match quality of several ways to make vectors, by (case, pooling): a row for each, one for each case and each pooling alone,
    and one for all, which add up the counts."""
    parts = None
    for (case, pooling), embed in embedders.items():
        scored = pairs.withColumns({"a": embed(F.col("sentence1")), "b": embed(F.col("sentence2"))})
        part = scored.select("is_match", cosine_batch(F.col("a"), F.col("b")).alias("similarity"), F.lit(case).alias("case"), F.lit(pooling).alias("pooling"))
        parts = part if parts is None else parts.unionByName(part)
    both = parts.withColumn("side", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(p).alias("p")) for c in (True, False) for p in (True, False)])))
    both = both.select("is_match", "similarity", F.when(F.col("side.c"), F.col("case")).alias("case"), F.when(F.col("side.p"), F.col("pooling")).alias("pooling"))
    return evaluation.sweep(both, (threshold,), ["case", "pooling"])
