"""Graph search against exact search, and long keyword lists against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from echolake import queries
from echolake.functions import keywords
from echolake.operators import evaluation, graph, retrieval


def test_graph_search_finds_nearly_all(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 24))
    x = [base[i % 12] + rng.normal(size=24) * (0.6 if i % 2 else 1.0) for i in range(900)]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(2000 + i, [0.5] * 24) for i in range(60)]  # copies, more than a vector has neighbours
    rows += [(3000, None), (3001, []), (3002, [1.0, 2.0])]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    built = graph.build(store, cell=64, entries=20)  # a few doors, so that the graphs are what leads there
    assert len(built.layers) == 3 and built.doors.count() == 20
    held = {r["vec_id"]: r["neighbours"] for r in built.layers[0].collect()}
    assert set(held) == {i for i, v in rows if v and len(v) == 24}
    assert all(len(n) <= graph.DEGREE and len(set(n)) == len(n) and i not in n for i, n in held.items())
    asked = store.where("vec_id % 3 = 0").withColumnRenamed("vec_id", "query_id")
    found = graph.search(asked, built, 3, beam=64, width=16).persist()
    exact = retrieval.knn(asked.where(F.size("embedding") == 24), store.where(F.size("embedding") == 24), 3)
    apart = F.col("query_id") < 2000  # copies of one vector are found in any order
    assert retrieval.recall_at_k(found.where(apart), exact.where(apart), 3).agg(F.avg("recall")).first()[0] >= 0.9
    best = {r["query_id"]: r["similarity"] for r in found.where("rank = 1").collect()}
    assert len(best) == asked.where(F.size("embedding") == 24).count() and sum(s > 0.99999 for s in best.values()) >= 0.98 * len(best)
    others = graph.search(asked, built, 2, beam=32, width=16, exclude_self=True)
    assert others.where("query_id = vec_id").count() == 0 and others.groupBy("query_id").count().where("count != 2").count() == 0
    found.unpersist()


def test_small_and_empty_graphs(spark):
    one = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [1.0, 1.0]), (8, None), (9, [1.0])], "query_id long, embedding array<float>")
    built = graph.build(one)
    assert [r.asDict() for r in graph.search(asked, built).collect()] == [{"query_id": 7, "vec_id": 1, "similarity": 0.707107, "rank": 1}]
    nothing = graph.build(one.limit(0))
    assert nothing.layers[0].count() == 0 and graph.search(asked, nothing).count() == 0


def test_a_step_of_the_search_is_one_join(spark):
    store = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>")
    plan = graph.search(store.withColumnRenamed("vec_id", "query_id"), graph.build(store, degree=4))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_beam_grows_with_what_is_hard_to_find(spark, monkeypatch):
    monkeypatch.setattr(graph, "BEAM", 6)
    rng = np.random.default_rng(4)
    store = spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(500)], "vec_id long, embedding array<float>").repartition(3)
    asked, built = store.withColumnRenamed("vec_id", "query_id"), graph.build(store, degree=6, cell=64, entries=200)
    exact = retrieval.knn(asked, store, 3).persist()
    share = lambda beam: retrieval.recall_at_k(graph.search(asked, built, 3, beam=beam, width=max(1, beam // 4)), exact, 3).agg(F.avg("recall")).first()[0]
    beam = graph.tune(asked, store, built, 3, 0.9, sample=200)
    assert share(6) < 0.9 <= share(beam) and beam < 500
    exact.unpersist()


def test_copies_are_found_as_well_as_others(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(150)] + [(500 + i, [0.5] * 16) for i in range(60)] + [(900, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert queries.graph_recall(spark, str(tmp_path)).collect() == [(210, True, True)]


def test_long_keyword_lists(spark):
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abé x") for _ in range(n))
    words = [say(rng.randrange(3, 7)) for _ in range(3000)]
    texts = [(i, say(rng.randrange(0, 9))) for i in range(300)] + [(900, None), (901, ""), (902, "zzz " * 50_000 + words[0])]
    docs = spark.createDataFrame(texts, "id long, text string")
    wanted = {i: None if t is None else any(w in t for w in words) for i, t in texts}
    for block in (1 << 20, 500):
        hit = keywords.keyword_matcher(spark, words, block)
        assert {r["id"]: r["hit"] for r in docs.select("id", hit("text").alias("hit")).collect()} == wanted
    for listed, answer in (([], False), (["", "a"], True)):
        got = docs.select("id", keywords.keyword_matcher(spark, listed)(F.col("text")).alias("hit")).collect()
        assert all(r["hit"] is (None if r["id"] == 900 else answer) for r in got)


def test_sweep_equals_one_threshold_at_a_time(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.5, 0.8, 0.85, rng.random()]), rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, similarity double, is_match boolean, differs boolean")
    cuts = (0.2, 0.5, 0.8, 0.85, 0.99)
    got = {(r["g"], r["veto"], r["threshold"]): r for r in evaluation.sweep(df, cuts, ["g"], vetoed=F.col("differs"), both=True).collect()}
    assert len(got) == 30
    for veto in (False, True):
        for cut in cuts:
            for r in evaluation.confusion(df, ["g"], vetoed=F.col("differs") & F.lit(veto), threshold=F.lit(cut)).collect():
                other = got[r["g"], veto, cut]
                assert {c: other[c] for c in r.asDict()} == r.asDict()


def test_first_neighbours_are_nearly_true(spark):
    rng = np.random.default_rng(8)
    store = spark.createDataFrame([(i, rng.normal(size=24).tolist()) for i in range(3000)], "vec_id long, embedding array<float>").repartition(3)
    lists = graph._first(store, 3000, 16, 1500)
    assert lists.count() == 3000 and graph._had(lists, store, 16) >= 0.75
    built = graph.build(store, degree=16, cell=16, entries=4000)  # small cells, so that rounds must follow
    found = graph.search(store.limit(300).withColumnRenamed("vec_id", "query_id"), built, 3, beam=48, width=12).persist()
    exact = retrieval.knn(store.withColumnRenamed("vec_id", "query_id"), store, 3).join(found.select("query_id").distinct(), "query_id", "left_semi")
    assert retrieval.recall_at_k(found, exact, 3).agg(F.avg("recall")).first()[0] >= 0.9
    found.unpersist()


def test_planned_sizes_of_a_search_grow_slowly(spark):
    rng = np.random.default_rng(9)
    store = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "vec_id long, embedding array<float>")
    found = graph.search(store.withColumnRenamed("vec_id", "query_id"), graph.build(store, degree=4), 3, beam=40, width=2)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size.bit_length() < 8_000  # bits; they doubled in each round when beams were co-grouped with beams
    assert found.where("rank = 1 and query_id = vec_id").count() >= 390
