"""Question sets, labelled pairs, conversation exports, vocabularies and verified downloads."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``q`` of every line of a JSONL file, or the line itself where it is no such JSON; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select(F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$.q", "string"), F.col("value")).alias("q"))
    return got.limit(limit) if limit else got


def read_pairs(spark: SparkSession, path: str, first: str, second: str, label: str, limit: int | None = None) -> DataFrame:
    """sentence1, sentence2 and is_match of a labelled Parquet set; other columns are not read."""
    got = spark.read.parquet(path).select(F.col(first).alias("sentence1"), F.col(second).alias("sentence2"), (F.col(label).cast("double") >= 0.5).alias("is_match"))
    return got.limit(limit) if limit else got


def is_question(text: Column) -> Column:
    """5 to 200 characters and no number of eight digits or more."""
    return F.char_length(text).between(5, 200) & ~F.exists(F.split(text, r"\s+"), lambda w: w.rlike("[0-9]{8,}"))


def export_questions(conversations: DataFrame) -> DataFrame:
    """Distinct user questions, each at its first occurrence (conv_id, turn)."""
    q = conversations.where("role = 'user'").select("conv_id", "turn", F.trim("text").alias("q")).where(is_question(F.col("q")))
    first = q.groupBy("q").agg(F.min(F.struct("conv_id", "turn")).alias("at"))
    return first.select("q", "at.conv_id", "at.turn")


def first_occurrences(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def synthetic_clusters(spark: SparkSession, clusters: int = 15, size: int = 20, singles: int = 20, seed: int = 7) -> DataFrame:
    """``q`` and ``cluster``: paraphrases built from templates, and singletons."""
    rng = random.Random(seed)
    openings = ["how do I", "what is the way to", "can you tell me how to", "please explain how to", "steps to"]
    verbs = ["reset", "update", "cancel", "export", "share", "archive", "rename", "restore", "install", "configure"]
    things = ["password", "invoice", "profile", "report", "calendar", "router", "backup", "contract", "playlist", "printer"]
    rows = []
    for c in range(clusters):
        act = f"{verbs[c % len(verbs)]} my {things[(c * 7 + c // 10) % len(things)]}"
        endings = ["", " today", " quickly", " on a phone"]
        rows += [(f"{openings[k % 5]} {act}{endings[k // 5 % 4]}?", f"c{c}") for k in range(size)]
    rows += [(f"single question {k} about {rng.choice(things)} {rng.randrange(10**4)}", "extra") for k in range(singles)]
    return spark.createDataFrame(rows, "q string, cluster string")


def verify_files(spark: SparkSession, path: str, expected: dict[str, tuple[int, str]]) -> DataFrame:
    """name, length, sha256 and ok of the files under ``path`` against their expected sizes and digests."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    wanted = spark.createDataFrame([(k, n, h) for k, (n, h) in expected.items()], "name string, wanted_length long, wanted_sha256 string")
    both = wanted.join(files, "name", "left")
    return both.select("name", "length", "sha256", F.coalesce((F.col("length") == F.col("wanted_length")) & (F.col("sha256") == F.col("wanted_sha256")), F.lit(False)).alias("ok"))


def read_vocabulary(spark: SparkSession, path: str, least: int = 1001) -> dict[str, int]:
    """Token to line number.  Every line, also a blank one, takes a number; fewer than ``least`` lines are an error."""
    text = spark.read.text(path, wholetext=True).first()
    lines = text["value"].split("\n") if text else []
    if lines and lines[-1] == "":
        lines.pop()
    if len(lines) < least:
        raise ValueError(f"a vocabulary has at least {least} lines, this one has {len(lines)}")
    return {w.removesuffix("\r"): i for i, w in enumerate(lines)}
