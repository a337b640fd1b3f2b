"""Timers of event time: silent streams and expired entries, over restarts, against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from echolake.streaming import sse_stream, timers

START = datetime(2025, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fed(spark, tmp_path, batches, schema, make):
    """All that a streaming query gives for ``batches``, with a restart from its checkpoint after each."""
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    spark.createDataFrame([], schema).write.parquet(source)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        query = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).collect()


def when(seconds):
    return START + timedelta(seconds=seconds)


def test_idle_streams(spark, tmp_path, rocksdb):
    schema = "stream_id string, seq long, ts timestamp, chunk string, final boolean"
    first = [("a", 0, when(0), "xx", False), ("b", 0, when(1), "é", False), ("c", 0, when(2), "c", False), ("d", 0, when(3), None, True)]
    second = [("a", 1, when(8), "yyy", False), ("b", 1, when(30), "late", True), ("d", 1, when(9), "after its end", False)]
    third = [("a", 2, when(17), "z", True), ("e", 0, when(60), "e", False)]
    last = [("e", 1, when(61), "e", True), ("f", 0, when(200), "f", False)]
    got = {(r["stream_id"], r["outcome"], r["at"] // 1000 - int(START.timestamp()), r["chunks"], r["bytes"]) for r in fed(spark, tmp_path, [first, second, third, last], schema, lambda df: timers.idle_aborts(df, 10_000))}
    assert ("d", "ended", 3, 1, 0) in got and ("b", "idle", 11, 1, 2) in got and ("c", "idle", 12, 1, 1) in got and ("e", "ended", 61, 2, 2) in got
    assert {s for s, *_ in got} == set("abcde") and len(got) == 5  # f is still open


def test_idle_streams_as_the_batch_finds_them(spark, tmp_path, rocksdb):
    rng = random.Random(6)
    rows = []
    for s in range(12):
        at = 0.0
        for seq in range(6):
            at += rng.choice([1, 3, 9, 14])
            rows.append((f"s{s}", seq, when(at), "data", seq == 5))
    rows.sort(key=lambda r: r[2])
    schema = "stream_id string, seq long, ts timestamp, chunk string, final boolean"
    batches = [rows[:30], rows[30:55], rows[55:], [("end", 0, when(1000), "", False)]]
    got = {r["stream_id"]: r["outcome"] for r in fed(spark, tmp_path, batches, schema, lambda df: timers.idle_aborts(df, 10_000))}
    batch = {r["stream_id"]: r["idle_abort"] for r in sse_stream.idle_gaps(spark.createDataFrame(rows, schema), 10.0).collect()}
    assert {s: o == "idle" for s, o in got.items()} == batch


def test_lifetimes(spark, tmp_path, rocksdb):
    rng = random.Random(2)
    rows = [(rng.choice(["n", "m", None]), i, when(i + rng.random()), rng.choice(["put", "get", "get"]), f"k{rng.randrange(6)}") for i in range(120)]
    rows.append(("end", 1000, when(10_000), "get", "x"))
    schema = "namespace string, seq long, ts timestamp, op string, key string"
    found = fed(spark, tmp_path, [rows[:40], rows[40:90], rows[90:120], rows[120:]], schema, lambda df: timers.entry_lifetimes(df, 15_000))
    born: dict = {}
    wanted, lives = {}, []
    for n, i, ts, op, k in rows:
        at = int(ts.timestamp() * 1000)
        live = (n or "", k) in born and at - born[n or "", k] < 15_000
        wanted[i] = {"put": ("stored", "replaced"), "get": ("miss", "hit")}[op][live]
        if op == "put":
            if (n or "", k) in born and not live:
                lives.append((n or "", k, born[n or "", k] + 15_000))
            born[n or "", k] = at
    lives += [(n, k, at + 15_000) for (n, k), at in born.items()]
    assert {r["seq"]: r["outcome"] for r in found if r["seq"] is not None} == wanted
    purged = [(r["namespace"], r["key"], r["at"]) for r in found if r["seq"] is None]
    # an expired key that is put again before the watermark has passed it lives on under its new time
    assert set(purged) <= set(lives) and {p[:2] for p in purged} == {x[:2] for x in lives} and len(purged) == len(set(purged))
