"""The registered queries over whole tables, against SQL or brute force; and the pipeline."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_packing_and_benchmark import brute_force as contaminated
from test_search_and_dedup import brute_force as components

import corpus_pipeline
from echolake.llm import packing, quality, queries, toxicity
from echolake.llm.base import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "conversations", "embeddings", "documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str) == sorted([tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()], key=str)


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]


def benchmark(spark):
    return [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]


def test_decontamination(spark):
    got = sorted([tuple(r) for r in queries.op4_decontaminate(spark, DATA).collect()], key=str)
    assert got == contaminated(documents(spark), benchmark(spark))


def test_near_duplicates(spark):
    got = sorted([tuple(r) for r in queries.op10_lsh_forest(spark, DATA).collect()], key=str)
    assert got == components(documents(spark))


def test_packing(spark):
    rows = queries.op7_bestfit_packing(spark, DATA).collect()
    encode = packing.Encoder(packing.tokenizer_path())
    lengths: dict = {}
    fill: dict = {}
    for r in rows:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths == {i: len(encode.whole(t or "")) // 4 + 1 for i, t in documents(spark)}
    bound = packing.lower_bound(np.array([r["length"] for r in rows]), 2048)
    assert bound <= len(fill) <= bound + 1
    for held in fill.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048


def test_scores_cover_all(spark):
    n = len(documents(spark))
    for name in ("op2_quality_pu", "op3_cross_entropy_difference", "op6_toxicity", "op9_langid_ftrl"):
        assert queries.queries()[name](spark, DATA).count() == n


def test_pipeline_against_brute_force(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = documents(spark)
    for train, accept in ((toxicity.train, lambda s: s < 0.5), (quality.train, lambda s: s >= 0.5)):
        model = train(docs, labels)
        rows = [r for r, s in zip(rows, model.score([t or "" for _, t in rows])) if accept(s)]
        docs = docs.where(docs.doc_id.isin([i for i, _ in rows]))
    kept = {i for i, _, c, k in components(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    bad = {r[0] for r in contaminated(rows, benchmark(spark)) if r[-1]}
    rows = [r for r in rows if r[0] not in bad]
    got = corpus_pipeline.run(spark, DATA).collect()
    assert {r["doc_id"] for r in got} == {i for i, _ in rows}
    encode = packing.Encoder(packing.tokenizer_path())
    assert sum(r["length"] for r in got) == sum(len(encode.whole(t or "")) // 4 + 1 for _, t in rows)


def odd_documents(spark):
    """Documents with nulls, empty, repeated and very long texts, repeated and missing ids, and columns that clash with the operators' own."""
    some = table(spark, DATA, "documents").limit(60)
    near = " ".join(f"word{i}" for i in range(80))
    passage = table(spark, DATA, "benchmark").first()["text"]
    rows = [(9001, None), (9002, ""), (9003, near), (9004, near + " more"), (9003, near), (9005, near), (None, near), (None, None), (9006, "long words here " * 40_000), (9007, passage), (9008, " \n ")]
    extra = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], some.schema)
    clash = {c: F.lit(None).cast(t) for c, t in {"score": "string", "_row": "long", "component_id": "double", "hits": "string", "items": "long", "n_words": "string", "kept": "int", "row": "string", "length": "string"}.items()}
    return some.union(extra).withColumns(clash | {"held": F.create_map(F.lit("k"), F.col("doc_id")), "_c": F.array("text")})


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.dtypes == docs.dtypes, name
        rows = got.collect()
        ids = [r["doc_id"] for r in rows]
        assert 0 < len(rows) <= total
        if name == "near-dedup":
            assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None}) and {9001, 9002, 9003, 9008} <= set(ids) and not {9004, 9005} & set(ids)
        if name == "decontamination":
            assert 9007 not in ids and {9001, 9002, 9006, None} <= set(ids)
        assert stage(spark, docs.limit(0), DATA).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id", "piece").count() >= total


def test_texts_of_one_id_are_judged_each(spark):
    from echolake.llm import near_dedup

    say = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, say("a")), (2, say("b")), (2, say("c")), (2, say("a") + " more"), (3, say("c")), (4, say("d")), (4, say("d")), (5, say("e")), (5, None), (6, None), (None, say("b")), (5, "")]
    docs = spark.createDataFrame([(i, t, None, f"s{k}", None) for k, (i, t) in enumerate(rows)], table(spark, DATA, "documents").schema)
    got = sorted(((r["doc_id"], r["text"]) for r in near_dedup.deduplicate(docs).collect()), key=str)
    assert got == sorted([(1, say("a")), (2, say("b")), (3, say("c")), (4, say("d")), (5, say("e")), (5, ""), (6, None), (None, say("b"))], key=str) or got == sorted(
        [(1, say("a")), (2, say("b")), (3, say("c")), (4, say("d")), (5, say("e")), (5, None), (6, None), (None, say("b"))], key=str
    )


def test_nothing_is_left_behind(spark):
    from echolake.llm import base

    before = set(base._written)
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert len(base._written - before) == 1  # the result


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, DATA)
        assert got.columns == docs.columns and stage(spark, docs.limit(0), DATA).count() == 0
