"""The filter audit against a plain loop over documents and orders."""

from __future__ import annotations

import re
from itertools import permutations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolake.llm import filter_audit

DOCS, LABELS = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"


def brute_force(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least: dict = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failing = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        failing.append(
            (
                s or "",
                i,
                {
                    f
                    for f, bad in zip(
                        "ABCDE",
                        (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), i is not None and least[t] < i),
                    )
                    if bad
                },
            )
        )
    out = {}
    for part in {p for p, _, _ in failing}:
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in failing if p == part]
            gone: list = []
            for step, name in enumerate(order, 1):
                lost = [(i, f) for i, f in left if name in f]
                redundant = sum(name in f for _, f in gone)
                gone += lost
                left = [(i, f) for i, f in left if name not in f]
                removed_by[name] += len(lost)
                unique = sum(f == {name} for p, _, f in failing if p == part)
                out[part, "".join(order), step] = [len(left), len(lost), redundant, unique, sum(i in good for i, _ in lost), sum(i in toxic for i, _ in lost), name]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    rows = filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in rows}
    assert len(got) == len(rows)
    return got


WORDY = " ".join(f"word{k}" for k in range(60))
ODD = [
    (1, WORDY, "a"),
    (2, WORDY, "b"),
    (2, WORDY, "b"),  # the same row again
    (1, WORDY, None),  # the smallest id again, elsewhere
    (3, None, None),
    (4, "", "a"),
    (None, WORDY, "a"),
    (None, WORDY, "a"),
    (5, "word " * 60, "a"),
    (6, WORDY.upper(), "b"),
    (7, WORDY + " 100 %", ""),
    (8, "x\x0by\x1cz\x85 " + WORDY, "a"),
    (9, "Été " * 60, "a"),
    (10, "long text " * 100_000, "a"),
    (-3, WORDY, "c"),
]
MARKS = [(1, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (5, None, 1), (99, 1, 1), (4, 1, None)]


def test_odd_rows(spark):
    assert audited(spark, ODD, MARKS) == brute_force(ODD, MARKS)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.sampled_from([None, "", WORDY, WORDY.upper(), "word " * 70, WORDY + "$", "A#"]), st.sampled_from([None, "a", "b"])), max_size=25), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1), st.integers(0, 1)), max_size=6))
def test_any_rows(spark, docs, labels):
    assert audited(spark, docs, labels) == brute_force(docs, labels)


def test_empty_and_clashing_names(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    labels = spark.createDataFrame(MARKS, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("n", "mask", "part", "digest", "spread", "good", "f", "quality")})
    assert sorted(filter_audit.audit(clash, labels.withColumn("text", F.lit(1))).collect()) == sorted(filter_audit.audit(docs, labels).collect())


def test_only_python_free_plans(spark):
    plan = filter_audit.audit(spark.createDataFrame(ODD, DOCS), spark.createDataFrame(MARKS, LABELS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
