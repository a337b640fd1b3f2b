"""Operators that work on one hot key, cache or pool in many tasks, against plain loops."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.operators import merging, metrics, retrieval, stack_distance
from echolake.operators.running import positions, running_sums


@pytest.fixture
def many_ranges(spark):
    """Every exchange keeps its partitions, so that small tables are several ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def plain_leaders(rows):
    out = {}
    for b, key, begun, _ in rows:
        found = [(a_begun, a) for a, k, a_begun, a_ended in rows if k == key and a_begun < begun < a_ended]
        if found:
            out[b] = min(found)[1]
    return out


@pytest.mark.parametrize("width", [0.5, 7.0, 1e6])
def test_flights_of_any_length(spark, width):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        begun = float(rng.randrange(60))
        rows.append((i, None if i % 11 == 0 else "hot", begun, begun + rng.choice([0, 1, 3, 40, 1e12])))
    df = spark.createDataFrame(rows, "request_id long, key string, started double, ended double")
    got = {r["request_id"]: r["leader_id"] for r in merging.merge_exact(df, width).collect()}
    assert got == plain_leaders(rows)


def test_one_key_and_slice_grows_in_proportion(spark):
    def took(n):
        df = spark.range(n).select(F.col("id").alias("request_id"), F.lit("hot").alias("key"), (F.col("id") / 7).alias("started"), (F.col("id") / 7 + 3).alias("ended"))
        began = time.time()
        assert merging.merge_exact(df, 1e9).count() == n - 1
        return time.time() - began

    took(2_000)
    small, large = took(20_000), took(200_000)
    assert large < 20 and large < 40 * max(small, 0.5)


@pytest.mark.parametrize("threshold", [0.95, 0.6, -0.2])
def test_similar_flights_of_a_hot_namespace(spark, threshold):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(9, 6))
    rows = []
    for i in range(260):
        v = base[i % 9] + rng.normal(size=6) * 0.2
        vector = None if i == 5 else [0.0] * 6 if i == 6 else [1.0, 2.0] if i in (7, 8) else [float(x) for x in v.astype(np.float32)]
        begun = float(rng.integers(50))
        rows.append((i, "" if i % 10 else "other", f"item {i % 3}", vector, begun, begun + float(rng.choice([0, 2, 9, 1e9]))))
    df = spark.createDataFrame(rows, "request_id long, namespace string, text string, embedding array<float>, started double, ended double")
    wanted = {}
    for b in rows:
        found = []
        for a in rows:
            if a[1] == b[1] and a[2] == b[2] and a[3] and b[3] and len(a[3]) == len(b[3]) and a[4] < b[4] < a[5]:
                x, y = np.array(a[3]), np.array(b[3])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-8) >= threshold:
                    found.append((a[4], a[0]))
        if found:
            wanted[b[0]] = min(found)[1]
    for many, block in ((64, 8192), (5, 16), (1, 50)):
        got = merging.merge_semantic(df, 4.0, threshold, many=many, block=block).collect()
        assert {r["request_id"]: r["leader_id"] for r in got} == wanted
    assert merging.merge_semantic(df.limit(0), 4.0, threshold).count() == 0


def test_cells_leave_most_pairs_out(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in base[i % 40] + rng.normal(size=24) * 0.05]) for i in range(2000)]
    df = spark.createDataFrame(rows, "request_id long, embedding array<float>")
    centres = merging.pivots(df, 64)
    own = merging._celled(df, centres, 0.95, False).groupBy("cell").count().withColumnRenamed("count", "n")
    met = merging._celled(df, centres, 0.95, True).groupBy("cell").count().withColumnRenamed("count", "m")
    compared = own.join(met, "cell").agg(F.sum(F.col("n") * F.col("m"))).first()[0]
    assert compared < 0.2 * 2000 * 2000


def test_no_pairs_in_the_plan(spark):
    df = spark.createDataFrame([(1, "", "a", [1.0, 0.0], 0.0, 1.0)], "request_id long, namespace string, text string, embedding array<float>, started double, ended double")
    plan = merging.merge_semantic(df, 1.0)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def plain_distances(rows):
    out = {}
    for i, (cache, key) in enumerate(rows):
        since = set()
        for c, k in reversed(rows[:i]):
            if c == cache:
                if k == key:
                    out[i] = len(since)
                    break
                since.add(k)
        else:
            out[i] = None
    return out


@pytest.mark.parametrize("bits", [0, 3, 17])
def test_stack_distances(spark, many_ranges, bits):
    rng = random.Random(bits)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.choice(["k0", None, *[f"k{int(rng.expovariate(0.2))}" for _ in range(3)]])) for _ in range(230)]
    df = spark.createDataFrame([(i, c, k) for i, (c, k) in enumerate(rows)], "seq long, cache string, key string")
    got = stack_distance.distances(df.repartition(3), ["cache"], ["seq"], bits=bits)
    assert got.columns == ["seq", "cache", "key", "distance"]
    wanted = plain_distances(rows)
    assert {r["seq"]: r["distance"] for r in got.collect()} == wanted
    for r in stack_distance.miss_ratio_curve(df, ["cache"], ["seq"], bits=bits).collect():
        mine = [wanted[i] for i, (c, _) in enumerate(rows) if c == r["cache"]]
        assert (r["hits"], r["accesses"]) == (sum(d is not None and d < r["capacity"] for d in mine), len(mine))
    assert stack_distance.distances(df.limit(0), ["cache"], ["seq"], bits=bits).count() == 0


def test_one_cache_is_many_tasks(spark):
    n = 1 << 12
    df = spark.range(n).select(F.col("id").alias("seq"), F.lit("hot").alias("cache"), (F.col("id") % 97).cast("string").alias("key"))
    got = stack_distance.distances(df, ["cache"], ["seq"], bits=9)
    rows = got.groupBy("distance").count().collect()
    assert {r["distance"]: r["count"] for r in rows} == {None: 97, 96: n - 97}


def test_running_ring(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(metrics, "STRETCH", 50)
    rng = random.Random(9)
    outcomes = ["hit"] * 6 + ["bypass", "cache_write"]
    rows = [(i // 3, i, rng.choice(outcomes), rng.choice([None, 5, *range(40)])) for i in range(600)]
    df = spark.createDataFrame(rows, "ts long, seq long, outcome string, latency_ms long").repartition(3)
    got = {r["seq"]: (r["pool"], r["p50"], r["p99"]) for r in metrics.running_ring(df, ["ts", "seq"], [50, 99], size=37).collect()}
    held: dict = {"main": [], "bypass": []}
    wanted = {}
    for _, i, outcome, x in rows:
        if outcome == "cache_write" or x is None:
            continue
        pool = "bypass" if outcome == "bypass" else "main"
        held[pool] = (held[pool] + [x])[-37:]
        s = sorted(held[pool])
        wanted[i] = (pool, s[int(0.5 * (len(s) - 1))], s[int(0.99 * (len(s) - 1))])
    assert got == wanted
    assert metrics.running_ring(df.limit(0), ["ts", "seq"], [50]).count() == 0


def test_percentiles_of_a_hot_group(spark, many_ranges):
    rng = random.Random(1)
    rows = [("hot" if i % 4 else rng.choice(["a", None]), rng.choice([None, i, -i, 7])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = {r["g"]: (r["samples"], r["p0"], r["p50"], r["p95"], r["p100"]) for r in metrics.percentiles(df, "x", ["g"], [0, 50, 95, 100]).collect()}
    for g in {g for g, _ in rows}:
        s = sorted(x for h, x in rows if h == g and x is not None)
        assert got[g] == (len(s), *[s[int(p / 100 * (len(s) - 1))] for p in (0, 50, 95, 100)])
    s = sorted(x for _, x in rows if x is not None)
    assert tuple(metrics.percentiles(df, "x", [], [50]).first()) == (len(s), s[int(0.5 * (len(s) - 1))])
    assert metrics.percentiles(df.limit(0), "x", ["g"], [50]).count() == 0


def test_running_sums_of_equal_times(spark, many_ranges):
    rows = [(0 if i % 3 else i, i, -i if i % 5 else None, 0.5) for i in range(500)]
    df = spark.createDataFrame(rows, "t long, i long, v long, d double").repartition(5)
    got = running_sums(df, ["t", "i"], {"s": F.col("v"), "e": F.col("d")})
    stored = got.collect()
    total, part, wanted = 0, 0.0, {}
    for t, i, v, d in sorted(rows):
        total, part = total + (v or 0), part + d
        wanted[i] = (total, part)
    assert {r["i"]: (r["s"], r["e"]) for r in stored} == wanted
    assert {r["i"]: r["position"] for r in positions(df, ["t"], ["i"]).collect()} == {i: sum(u == t and j < i for u, j, _, _ in rows) for t, i, _, _ in rows}


def test_lookups_take_one_row_a_source(spark):
    store = spark.createDataFrame([(f"k{i}", "hot" if i % 3 else None, f"v{i}", i % 50) for i in range(300)] + [("hot", "x", "named", 7)], "key string, source string, value string, recency long")
    asked = spark.createDataFrame([(1, "hot"), (2, "k299"), (3, None), (4, "nothing"), (5, "x")], "query_id long, lookup string")
    got = {r["query_id"]: (r["key"], r["value"]) for r in retrieval.exact_lookup(asked, store).collect()}
    newest = max((i % 50, f"k{i}", f"v{i}") for i in range(300) if i % 3)
    assert got == {1: newest[1:], 2: ("k299", "v299"), 3: (None, None), 4: (None, None), 5: ("hot", "named")}
    many = spark.range(300).select(F.col("id").alias("query_id"), F.lit("hot").alias("lookup"))
    assert retrieval.exact_lookup(many, store).count() == 300
