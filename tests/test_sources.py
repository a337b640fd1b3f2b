"""Snapshots that survive a failed write, and SQLite tables read in parts."""

from __future__ import annotations

import sqlite3 as db_api

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.sources import datasets, snapshot
from echolake.sources.sqlite import SqliteReader, sqlite


def entries(spark, n, value="v"):
    return spark.range(n).select(
        F.concat(F.lit("msg:"), "id").alias("key"), F.lit(value).alias("value"), F.lit(None).cast("string").alias("source"), F.lit("").alias("sse"), F.array(F.lit(0.5).cast("float")).alias("embedding"), F.col("id").alias("ctime"), F.col("id").alias("last_access")
    )


def values(spark, path):
    return [r["value"] for r in snapshot.read_snapshot(spark, path, "fp").orderBy("key").collect()]


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    snapshot.write_snapshot(entries(spark, 3), path, "fp", 10)
    broken = entries(spark, 50, "new").repartition(4).withColumn("value", F.when(F.col("ctime") == 37, F.raise_error(F.lit("lost"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="lost"):
        snapshot.write_snapshot(broken, path, "fp", 100)
    assert values(spark, path) == ["v"] * 3
    snapshot.write_snapshot(entries(spark, 2, "next"), path, "fp", 10)
    assert values(spark, path) == ["next"] * 2
    for k in range(3):
        snapshot.write_snapshot(entries(spark, 1, f"v{k}"), path, "fp", 10)
    assert values(spark, path) == ["v2"] and len(list((tmp_path / "snapshot").glob("version=*"))) == 2


def test_a_reader_goes_on_while_a_snapshot_is_written(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    snapshot.write_snapshot(entries(spark, 3), path, "fp", 10)
    held = snapshot.read_snapshot(spark, path, "fp")
    snapshot.write_snapshot(entries(spark, 1, "new"), path, "fp", 10)
    assert held.count() == 3 and values(spark, path) == ["new"]


@pytest.fixture
def log(spark, tmp_path):
    path = str(tmp_path / "log of questions.db")
    with db_api.connect(path) as db:
        db.execute('CREATE TABLE "the log" (id INTEGER PRIMARY KEY, role TEXT, "text" VARCHAR(20), at REAL, odd)')
        db.executemany('INSERT INTO "the log" VALUES (?, ?, ?, ?, ?)', [(10 * i, "user" if i % 3 else "assistant", None if i % 7 == 0 else f"question number {i % 20}", i / 2, i if i % 2 else "x") for i in range(1, 201)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    db.close()
    return sqlite(spark).option("path", path)


def test_sqlite_in_parts(spark, log):
    df = log.option("table", "the log").option("rows", 300).load()
    assert df.dtypes == [("id", "bigint"), ("role", "string"), ("text", "string"), ("at", "double"), ("odd", "string")]
    assert df.rdd.getNumPartitions() == 7
    rows = {r["id"]: r for r in df.collect()}
    assert len(rows) == 200 and rows[70]["text"] is None and rows[30]["at"] == 1.5 and rows[30]["odd"] == "3" and rows[40]["odd"] == "x"
    assert log.option("table", "empty").load().count() == 0
    with pytest.raises(Exception, match="no table"):
        log.option("table", "absent").load()


def test_sqlite_filters(log):
    df = log.option("table", "the log").schema("text string, role string, id int").load()
    got = df.where("role = 'user' and text is not null and id > 100 and id in (110, 140, 200, 210, 2000) and text like '%1%'")
    assert sorted(r["id"] for r in got.collect()) == [i for i in (110, 140, 200, 210, 2000) if i // 10 % 3 and i // 10 % 7 and "1" in f"question number {i // 10 % 20}"] != []
    assert df.where("text is null").count() == 28 and df.where("role = 'nobody'").count() == 0


def test_filters_are_put_into_the_statement():
    schema = T._parse_datatype_string("id bigint, text string")
    reader = SqliteReader({"path": "x", "table": "t"}, schema)
    left = [ds.StringContains(("text",), "a"), ds.EqualTo(("other",), 1)]
    taken = [ds.GreaterThan(("id",), 5), ds.In(("text",), ("a", "b")), ds.IsNotNull(("text",))]
    assert list(reader.pushFilters([*taken, *left])) == left and len(reader.tests) == 3 and reader.values == [5, "a", "b"]


def test_questions_of_a_log(spark, log):
    conversations = log.option("table", "the log").schema("id long, role string, text string").load().select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), "role", "text")
    got = datasets.export_questions(conversations)
    assert got.count() == len({f"question number {i % 20}" for i in range(1, 201) if i % 3 and i % 7})
