from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolake.operators import cache_table
from echolake.streaming import cache_stream, sse_stream

PIECES = ['data: {"choices":[{"delta":{"content":"see http"}}]}\n\n', 'data: {"choices":[{"delta":{"content":"s://x.example"}}]}\r\n\r\n', "data: plain\r\r", "data: www.bad.example\n\n", ": note\n\n", "data: [DONE]\n\n", "data: cut"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=6), st.integers(1, 9), st.integers(0, 80))
def test_chunks_do_not_matter(parts, size, cap):
    text = "".join(parts)
    whole, split = sse_stream.Screen(cap=cap), sse_stream.Screen(cap=cap)
    once = whole.feed(text) + whole.feed("", final=True)
    pieces = "".join(split.feed(text[i : i + size]) for i in range(0, len(text), size)) + split.feed("", final=True)
    assert (once, whole.rejected, whole.truncated) == (pieces, split.rejected, split.truncated)


def test_split_url_is_found():
    s = sse_stream.Screen()
    out = s.feed(PIECES[0] + PIECES[1] + PIECES[4]) + s.feed("", final=True)
    assert s.rejected and out == PIECES[0]


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for stream in range(6):
        text = "".join(rng.choice(PIECES) for _ in range(5))
        cuts = [text[i : i + 17] for i in range(0, len(text), 17)] or [""]
        rows += [(f"s{stream}", k, c, k == len(cuts) - 1) for k, c in enumerate(cuts)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string, final boolean")
    for part in range(3):
        df.where((F.col("seq") >= part * 4) & ((F.col("seq") < part * 4 + 4) | F.lit(part == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {r["stream_id"]: (r["passed"], r["rejected"]) for r in sse_stream.screen_batch(df).collect()}
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse_stream.screen_stream(source).writeStream.format("memory").queryName("screened").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got: dict = {}
    for r in spark.table("screened").collect():
        text, rejected = got.get(r["stream_id"], ("", False))
        got[r["stream_id"]] = (text + r["passed"], rejected or r["rejected"])
    assert got == batch


def test_cache_stream_agrees_with_simulation(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(2)}", i, f"k{rng.randrange(12)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "namespace string, seq long, key string, now long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = cache_stream.exact_cache(source, 5, 40).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    online = sorted((r["namespace"], r["seq"], r["outcome"]) for r in spark.table("cached").collect())
    batch = sorted((r["cache"], r["seq"], r["outcome"]) for r in cache_table.simulate(df.withColumn("cache", F.col("namespace")), 5, 40).collect())
    assert online == batch and len({o for *_, o in online}) == 3


def test_singleflight(spark, tmp_path):
    v, w = [1.0, 0.0], [0.99, 0.05]
    rows = [
        ("a", 1, "begin", 1, "k", v, ["2024"]),
        ("a", 2, "begin", 2, "k", v, ["2024"]),
        ("a", 3, "begin", 3, "j", w, ["2024"]),
        ("a", 4, "begin", 4, "i", w, ["2025"]),
        ("a", 5, "end", 2, "k", None, None),
        ("a", 6, "end", 1, "k", None, None),
        ("a", 7, "begin", 5, "h", w, ["2024"]),
        ("b", 8, "begin", 6, "k", v, ["2024"]),
    ]
    df = spark.createDataFrame(rows, "namespace string, seq long, op string, request_id long, key string, embedding array<double>, entities array<string>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = cache_stream.singleflight(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("flights").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["outcome"], r["leader_id"], r["merged_by"]) for r in spark.table("flights").orderBy("seq").collect()]
    assert got == [("leader", None, None), ("merged", 1, "exact"), ("merged", 1, "semantic"), ("leader", None, None), ("stale", None, None), ("completed", None, None), ("leader", None, None), ("leader", None, None)]


def test_maintained_table(spark, tmp_path):
    schema = "key string, value string, source string, ctime long, last_access long"
    for i, rows in enumerate([[("a", "1", "s", 0, 1), ("b", "1", None, 90, 2)], [("a", "2", None, 95, 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cache_stream.maintain(str(tmp_path / "t"), source, str(tmp_path / "ck"), lambda n: 99 + n, 100, cache_table.upsert).awaitTermination(120)
    rows = {r["key"]: (r["value"], r["source"]) for r in cache_stream.current(spark, str(tmp_path / "t"), schema, cache_table.upsert).collect()}
    assert rows == {"a": ("2", "s"), "b": ("1", None)}
