"""Operators that replace pairwise or single-task forms: approximate search, replay, merging by sweep, ranges, online usage."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolake.functions import entities, requests, screen, sse
from echolake.functions.wordpiece import decode_bytes, hashing_embedder
from echolake.operators import ann, merging, replay, retrieval
from echolake.operators.running import ranges, running_sums
from echolake.plans import requests as plans
from echolake.sources import reports, snapshot
from echolake.streaming import cache_stream, sse_stream


def test_approximate_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2500)] + [(5000 + i, [1.0] * 16) for i in range(300)] + [(9000, None), (9001, [1.0, 2.0]), (9002, [])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = store.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    c = ann.centres(store, 24)
    index = ann.build(store, c)
    assert len(c) == 24 and sorted(r["vec_id"] for r in index.where("cell is null").collect()) == [9000, 9001, 9002]
    exact = retrieval.knn(asked, index.where("cell is not null"), 3, exclude_self=True)
    key = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect())
    assert key(ann.search(asked, index, c, 3, 24, exclude_self=True, block=100)) == key(exact)
    probes, measured = ann.tune(asked, index, c, 3, 0.9, sample=100, exclude_self=True)
    assert probes < 24 and measured >= 0.9
    whole = retrieval.recall_at_k(ann.search(asked, index, c, 3, probes, exclude_self=True), exact, 3).agg(F.avg("recall")).first()[0]
    assert whole >= 0.88
    none = store.limit(0)
    assert ann.search(asked.limit(0), ann.build(none, ann.centres(none, 4)), ann.centres(none, 4), 3, 2).count() == 0


def stored(df):
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_replay_against_a_loop(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    rows = []
    for i in range(150):
        k = int(rng.integers(12))
        v = base[k] + rng.normal(size=6) * 0.25
        rows.append((i, f"n{i % 2}" if i % 5 else None, f"text {k} {i % 30 if i % 3 else 'x'} {int(rng.integers(2)) if i % 4 == 0 else ''}".strip(), [float(x) for x in v] if i % 17 else None, i % 13 != 0))
    by_text: dict = {}
    rows = [(i, n, t, by_text.setdefault((n or "", t), v), c) for i, n, t, v, c in rows]  # one text, one vector
    df = spark.createDataFrame(rows, "seq long, namespace string, text string, embedding array<float>, cacheable boolean")
    got = {(r["round"], r["seq"]): r["status"] for r in replay.replay(df, 0.8, stored).collect()}
    tokens = lambda t: {k: sorted(set(x)) for k, x in zip("nai", plain_entities(t))}
    held: list = []
    for round_ in (1, 2):
        for i, n, t, v, c in rows:
            if not c:
                wanted = "bypass"
            elif v is None:
                wanted = "miss"
            else:
                x = np.array(v, dtype=np.float32).astype(float)
                hit = any(m == (n or "") and (u == t or (round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)), 6) >= 0.8 and tokens(u) == tokens(t))) for m, u, y in held)
                wanted = "hit" if hit else "miss"
                if not hit:
                    held.append((n or "", t, x))
            assert got[round_, i] == wanted, (round_, i)


@pytest.mark.parametrize("width", [3.0, 50.0, 1000.0])
def test_merging_by_sweep(spark, width):
    rng = random.Random(int(width))
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", float(rng.randrange(200)), 0.0) for i in range(400)]
    rows = [(i, k, a, a + rng.choice([0, 1, 5, 20, 150])) for i, k, a, _ in rows]
    df = spark.createDataFrame(rows, "request_id long, key string, started double, ended double")
    wanted = {}
    for i, k, t, _ in rows:
        live = [(a, j) for j, m, a, e in rows if m == k and a < t < e]
        if live:
            wanted[i] = min(live)[1]
    assert {r["request_id"]: r["leader_id"] for r in merging.merge_exact(df, width).collect()} == wanted


def test_ranges_are_even(spark):
    df = spark.range(10_000).withColumn("t", F.when(F.col("id") < 3000, 5.0).otherwise(F.col("id") ** 2))
    n = {r["b"]: r["count"] for r in df.groupBy(ranges(df, "t", 20, 100).alias("b")).count().collect()}
    assert max(v for k, v in n.items() if k != min(n)) < 1000 and len(n) > 10
    few = lambda **o: df.select(ranges(df, "t", **o).alias("b")).distinct().count()
    assert few(parts=20, least=2500) in (3, 4) and few() == 1
    for bucket in (None, ranges(df, "id", 20, 100)):
        got = running_sums(df, ["id"], {"s": F.lit(1)}, bucket).orderBy("id").collect()
        assert [r["s"] for r in got] == list(range(1, 10_001))
    nothing = df.limit(0)
    assert running_sums(nothing, ["id"], {"s": F.lit(1)}).count() == 0


USAGE = ['data: {"usage": {"prompt_tokens": 3, "completion_tokens":4}}\n', "data: [DO", "NE]\n\n", 'data: {"prompt_tokens": 9}\n', 'data: {"usage":{"prompt_tokens" : -1}}\r\n', ": note\n", 'data: {"usage":{"completion_tokens":"7"}}\n', "data: " + "x" * 20_000 + '"usage" "prompt_tokens":5\n', 'data: {"usage":{"prompt_tokens":12345']


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(USAGE), max_size=6), st.integers(1, 50))
def test_usage_is_the_same_in_any_chunks(parts, size):
    text = "".join(parts)
    whole, pieces = sse_stream.Usage(), sse_stream.Usage()
    whole.feed(text)
    for i in range(0, len(text), size):
        pieces.feed(text[i : i + size])
        assert len(pieces.line) <= 16_385 and len(pieces.tail) <= 5
    fields = lambda u: (u.prompt_tokens, u.completion_tokens, u.seen, u.done)
    assert fields(whole) == fields(pieces)


def test_usage_online_agrees_with_columns(spark, tmp_path):
    rng = random.Random(4)
    texts = {f"s{i}": "".join(rng.choice(USAGE) for _ in range(rng.randrange(1, 7))) for i in range(25)}
    rows = [(s, k, t[i : i + 700]) for s, t in texts.items() for k, i in enumerate(range(0, len(t), 700))]
    df = spark.createDataFrame(rows, "stream_id string, seq long, chunk string")
    batch = {r["stream_id"]: tuple(r)[1:] for r in sse_stream.usage_batch(df).collect()}
    columns = spark.createDataFrame(list(texts.items()), "stream_id string, t string").select("stream_id", sse.usage(F.col("t")).alias("u"), sse.has_done(F.col("t")).alias("done"))
    assert batch == {r["stream_id"]: (*r["u"], r["done"]) for r in columns.collect()}
    for part in range(3):
        df.where(F.col("seq") % 100 >= part * 5).where((F.col("seq") < part * 5 + 5) | F.lit(part == 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sse_stream.usage_stream(source).writeStream.format("memory").queryName("used").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["stream_id"] for r in spark.table("used").collect()} == set(texts)


def plain_entities(text):
    runs = re.findall("[A-Za-z0-9]+", text)
    kinds = ("[0-9]+", "[A-Z]+", "(?=.*[0-9])(?=.*[A-Za-z]).+")
    return [sorted({r for r in runs if re.fullmatch(k, r)}) for k in kinds]


def test_entities_of_random_texts(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abAB12-. é你") for _ in range(rng.randrange(40))) for _ in range(400)] + ["", "A1", "1a2", "AB", "12", "a12b 34"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entities.entity_tokens("t").alias("e")).collect()
    for r in rows:
        assert [list(r["e"][k]) for k in entities.KINDS] == plain_entities(r["t"]), r["t"]


def test_phrases_in_any_ascii_case(spark):
    texts = [(p.upper(), True) for p in screen.INJECTION_PHRASES] + [(f"x{p.title()}y", True) for p in screen.INJECTION_PHRASES] + [("jailbreaK", False), ("ignore  previous", False), ("", False)]
    got = spark.createDataFrame(texts, "t string, wanted boolean").select("t", "wanted", screen.contains_injection(F.col("t")).alias("x")).collect()
    assert all(r["x"] == r["wanted"] for r in got), [r for r in got if r["x"] != r["wanted"]]
    assert spark.createDataFrame([(None,)], "t string").select(screen.contains_injection(F.col("t")).alias("x")).first()["x"] is None


def test_upstream_failures(spark):
    rows = spark.createDataFrame([(200, False, "text/event-stream"), (0, True, None), (0, False, ""), (0, None, ""), (204, False, "TEXT/EVENT-STREAM; x"), (404, False, "text/event-stream"), (200, False, "application/json")], "s int, t boolean, c string")
    got = [tuple(r) for r in rows.select(requests.upstream_status(F.col("s"), F.col("t")), requests.passes_through(F.col("s"), F.col("c"))).collect()]
    assert got == [(200, True), (504, False), (502, False), (502, False), (204, True), (404, False), (200, False)]


def test_settings_are_compared(spark):
    pairs = spark.createDataFrame([("Rate A", "rate a", True), ("x y", "x z", False), ("same", "same", True)], "sentence1 string, sentence2 string, is_match boolean")
    plain, lower = hashing_embedder(32), lambda c: hashing_embedder(32)(F.lower(c))
    got = {(r["case"], r["pooling"]): r["tp"] + r["fp"] + r["tn"] + r["fn"] for r in plans.compare_settings(pairs, {("case", "mean"): plain, ("lower", "mean"): lower, ("case", "cls"): plain, ("lower", "cls"): lower}).collect()}
    assert got == {**{(c, p): 3 for c in ("case", "lower") for p in ("mean", "cls")}, ("case", None): 6, ("lower", None): 6, (None, "mean"): 6, (None, "cls"): 6, (None, None): 12}


def test_help_and_type_once_a_name(spark):
    row = spark.createDataFrame([(1, 2.5, 3, 4, -1)], "requests long, p50 double, p95 long, p99 long, uptime_seconds long")
    lines = [r["line"] for r in reports.exposition(row).orderBy("place").collect()]
    assert lines[:3] == ["# HELP cache_requests_total Cacheable requests: hits and misses.", "# TYPE cache_requests_total counter", "cache_requests_total 1"]
    assert sum(x.startswith("# TYPE cache_latency_milliseconds ") for x in lines) == 1 == sum(x.startswith("# HELP cache_latency_milliseconds ") for x in lines)
    assert 'cache_latency_milliseconds{quantile="0.5"} 2.500000' in lines and not any("uptime" in x for x in lines)


def test_invalid_bytes_become_text(spark):
    got = spark.createDataFrame([(bytearray(b"ok \xff\xc3"),), (bytearray("é".encode()),)], "b binary").select(decode_bytes(F.col("b")).alias("t")).collect()
    assert got[0]["t"].startswith("ok �") and got[1]["t"] == "é"


def test_key_sets(spark):
    a, b = (spark.createDataFrame([(k,) for k in x], "key string") for x in (["a", "a", "b"], ["a", "c"]))
    assert sorted(tuple(r) for r in retrieval.key_differences(a, b).collect()) == [("a", "a"), ("b", "a"), ("c", "b")]
    assert retrieval.key_differences(a, a).count() == 0


def test_tick(spark, tmp_path):
    schema = "key string, value string, source string, sse string, embedding array<float>, ctime long, last_access long"
    entries = spark.createDataFrame([("msg:1", "a", "one", None, [1.0, 0.0], 0, 1), ("msg:2", "b", "two", None, None, 90, 2), ("msg:3", "c", "three", None, [0.0, 1.0], 95, 3)], schema)
    log = spark.createDataFrame([(1, "hit", 5, 1, 1), (2, "miss", 7, 1, 1)], "event_id long, outcome string, latency_ms long, prompt_tokens long, completion_tokens long")
    searches = spark.createDataFrame([(i < 4,) for i in range(20)], "is_ghost boolean")
    got = cache_stream.tick(entries, log, searches, hashing_embedder(2), 100, 50, 2, str(tmp_path / "s"), "fp")
    assert (got["purged"], got["kept"], got["rebuild"], got["ghost_percent"]) == (1, 2, True, 20) and got["line"].startswith("requests=2 hits=1")
    rows = {r["key"]: r for r in snapshot.read_snapshot(spark, str(tmp_path / "s"), "fp").collect()}
    assert set(rows) == {"msg:2", "msg:3"} and rows["msg:2"]["embedding"] is not None
    quiet = cache_stream.tick(entries.where("ctime > 60"), log.limit(0), searches.where("not is_ghost"), hashing_embedder(2), 100, 50, 2, str(tmp_path / "t"), "fp")
    assert quiet["line"] is None and not quiet["rebuild"] and quiet["purged"] == 0
    assert {r["key"]: r["embedding"] is None for r in snapshot.read_snapshot(spark, str(tmp_path / "t"), "fp").collect()} == {"msg:2": True, "msg:3": False}


def test_maintained_table_is_compacted(spark, tmp_path):
    from echolake.operators import cache_table

    schema = "key string, value string, source string, ctime long, last_access long"
    at = str(tmp_path / "t")
    for i in range(7):
        spark.createDataFrame([(f"k{i % 5}", str(i), "s" if i == 1 else None, i, i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cache_stream.maintain(at, source, str(tmp_path / "ck"), lambda n: n, 5, cache_table.upsert, compact=2).awaitTermination(120)
    names = sorted(p.name for p in (tmp_path / "t").iterdir())
    assert names == ["changes=4", "changes=5", "changes=6", "whole=3", "whole=5"]
    assert {r["key"]: r["value"] for r in spark.read.parquet(f"{at}/whole=5").collect()} == {"k0": "5", "k1": "1", "k2": "2", "k3": "3", "k4": "4"}
    rows = {r["key"]: (r["value"], r["source"]) for r in cache_stream.current(spark, at, schema, cache_table.upsert).collect()}
    assert rows == {"k0": ("5", None), "k1": ("6", "s"), "k2": ("2", None), "k3": ("3", None), "k4": ("4", None)}
    assert cache_stream.current(spark, str(tmp_path / "none"), schema, cache_table.upsert).count() == 0


def test_a_block_product_is_held_in_parts():
    rng = np.random.default_rng(5)
    queries, store = rng.integers(-2, 3, size=(3_000, 4)).astype(float), rng.integers(-2, 3, size=(6_000, 4)).astype(float)  # of many ties
    ids = rng.permutation(6_000)
    tracemalloc.start()
    (rows, cols), sim = retrieval._best(queries, store, ids, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # the whole product alone is 144 MB
    for i in range(0, 3_000, 211):
        all_ = np.round(np.clip(store @ queries[i] / (np.linalg.norm(store, axis=1) * np.linalg.norm(queries[i]) + 1e-8), -1, 1), 6)
        wanted = np.lexsort((ids, -all_))[:3]
        assert cols[rows == i].tolist() == wanted.tolist() and np.allclose(sim[rows == i], all_[wanted], atol=2e-6)


def test_replay_in_rounds_without_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9, 5))
    rows = [(i, f"n{i % 2}", f"ask {i} words"[: 4 + i % 3], [float(v) for v in base[int(rng.integers(9))] + rng.normal(size=5) * 0.5]) for i in range(300)] + [(900, "n0", "ask", [])]
    df = spark.createDataFrame(rows, "seq long, namespace string, text string, embedding array<float>")
    got = {r["seq"]: r["stored"] for r in replay.stored_first(df, 0.8, ["namespace"], stored, block=16).collect()}
    held: list = []
    for i, n, _, v in rows:
        x = np.array(v, dtype=np.float32).astype(float)
        hit = any(m == n and len(x) == len(y) and round(float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8)), 6) >= 0.8 for m, y in held)
        assert got[i] != hit, i
        if not hit:
            held.append((n, x))
    alike = spark.createDataFrame([(i, "", "a" * (i + 1), [1.0, 0.001 * i]) for i in range(300)], "seq long, namespace string, text string, embedding array<float>").withColumn("cacheable", F.lit(True))
    counts = []

    def counted(t):
        counts.append(t.count())
        return stored(t)

    assert replay.replay(alike, 0.8, counted).where("status = 'miss'").count() == 1
    assert max(counts) <= 300  # not the 44,850 pairs


def test_cells_that_spare_nothing_are_not_copied_to(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, "", "ask", [float(x) for x in rng.normal(size=32)], float(i), i + 40.0) for i in range(500)], "request_id long, namespace string, text string, embedding array<float>, started double, ended double")
    made, celled = [], merging._celled

    def seen(rows, centres, threshold, copies):
        made.append(celled(rows, centres, threshold, copies))
        return made[-1]

    monkeypatch.setattr(merging, "_celled", seen)
    got = merging.merge_semantic(df, 10.0, 0.1)
    assert got.count() > 0 and made[1].count() <= 16 * 500  # every vector reaches nearly all of 64 cells
