"""Versions of an index: whole for readers, kept up while one is rebuilt, safe when a writer dies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from echolake.operators import index_table

SCHEMA = StructType().add("key", "string").add("embedding", ArrayType(FloatType()))
CHANGED = "key string, embedding array<float>, deleted boolean, seq long"


def held(df):
    return {r["key"]: r["embedding"] and r["embedding"][0] for r in df.collect()}


def put(spark, **values):
    return spark.createDataFrame([(k, None if v is None else [float(v)], v is None, i) for i, (k, v) in enumerate(values.items())], CHANGED)


def test_changes_and_rebuilds(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert held(index_table.read(spark, path, SCHEMA)) == {} and index_table.manifest(spark, path) is None
    index_table.apply(path, put(spark, a=1, b=2))
    index_table.apply(path, put(spark, b=3, c=4))
    old = index_table.read(spark, path, SCHEMA)
    index_table.apply(path, put(spark, a=None, d=5))
    twice = spark.createDataFrame([("c", [8.0], False, 2), ("c", [7.0], False, 1), ("c", None, True, 0)], CHANGED)
    index_table.apply(path, twice)
    assert held(index_table.read(spark, path, SCHEMA)) == {"b": 3, "c": 8, "d": 5}
    assert held(old) == {"a": 1, "b": 3, "c": 4}  # a reader keeps the version of its plan

    def make(entries):
        index_table.apply(path, put(spark, e=6, b=None))  # comes while the new base is made
        return entries.withColumn("embedding", F.transform("embedding", lambda x: (x * 10).cast("float")))

    got = index_table.rebuild(spark, path, SCHEMA, make)
    assert len(got["changes"]) == 1 and held(index_table.read(spark, path, SCHEMA)) == {"c": 80, "d": 50, "e": 6}
    index_table.rebuild(spark, path, SCHEMA, lambda entries: entries)
    assert index_table.manifest(spark, path)["changes"] == [] and held(index_table.read(spark, path, SCHEMA)) == {"c": 80, "d": 50, "e": 6}
    assert held(index_table.read(spark, path, SCHEMA, 1)) == {"a": 1, "b": 3, "c": 4}


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index_table.apply(path, put(spark, a=1))
    swap = index_table._swap

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(index_table, "_swap", killed)
    with pytest.raises(KeyboardInterrupt):
        index_table.rebuild(spark, path, SCHEMA, lambda entries: entries.limit(0))
    with pytest.raises(KeyboardInterrupt):
        index_table.apply(path, put(spark, z=9))
    assert held(index_table.read(spark, path, SCHEMA)) == {"a": 1}
    monkeypatch.setattr(index_table, "_swap", swap)
    index_table.apply(path, put(spark, b=2))
    assert held(index_table.read(spark, path, SCHEMA)) == {"a": 1, "b": 2}
    assert len(index_table.vacuum(spark, path)) == 2 and index_table.vacuum(spark, path) == []
    assert held(index_table.read(spark, path, SCHEMA)) == {"a": 1, "b": 2}


def test_writers_at_once_build_on_each_other(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    index_table.apply(path, put(spark, a=1))
    swap, others = index_table._swap, [put(spark, b=2), put(spark, c=3)]

    def slow(session, at, made):
        if others:  # another writer is first, twice
            other = others.pop()
            monkeypatch.setattr(index_table, "_swap", swap)
            index_table.apply(path, other)
            monkeypatch.setattr(index_table, "_swap", slow)
        swap(session, at, made)

    monkeypatch.setattr(index_table, "_swap", slow)
    index_table.apply(path, put(spark, d=4))
    assert held(index_table.read(spark, path, SCHEMA)) == {"a": 1, "b": 2, "c": 3, "d": 4} and index_table.manifests(spark, path) == [0, 1, 2, 3]
    index_table.vacuum(spark, path, keep=1)
    assert index_table.manifests(spark, path) == [3] and held(index_table.read(spark, path, SCHEMA)) == {"a": 1, "b": 2, "c": 3, "d": 4}
