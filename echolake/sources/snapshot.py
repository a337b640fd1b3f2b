"""Cache snapshots: folders of JSON rows, each a whole version.

A snapshot is written beside the one before (``version=<n>``) and counts when Spark has committed it, which the ``_SUCCESS`` file says;
then older ones go, but for the last, which a reader may still be at.  So a write that fails or is stopped leaves the old snapshot
as it was.  Plain folders and files without versions are read as well.

The first row type is the meta row (``key`` = ``__meta__``) with the fingerprint of how vectors were made.  Vectors are
stored as base64 of little-endian floats (``vec_b64`` and ``dim``); rows with a plain ``embedding`` array are read too, as
are single files that hold one JSON array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.functions.keys import fingerprint_differs
from echolake.functions.vectors import decode_vector, encode_vector
from echolake.operators.cache_table import is_live
from echolake.storage import remove

META_KEY = "__meta__"
SCHEMA = "key string, value string, src string, sse string, vec_b64 string, dim int, embedding array<float>, ctime bigint, fp string, place bigint"


def write_snapshot(entries: DataFrame, path: str, fingerprint: str, now: int, ttl: int = 0) -> None:
    """Write live entries (key, value, source, sse, embedding, ctime, last_access) and the meta row as the next version under ``path``."""
    spark = entries.sparkSession
    before = _versions(spark, path)
    target = f"{path}/version={max(_all(spark, path), default=-1) + 1}"
    rows = entries.where(is_live(F.col("ctime"), F.lit(now), ttl)).select(
        "key",
        "value",
        F.nullif("source", F.lit("")).alias("src"),
        F.nullif("sse", F.lit("")).alias("sse"),
        F.when(F.size("embedding") > 0, encode_vector(F.col("embedding"))).alias("vec_b64"),
        F.when(F.size("embedding") > 0, F.size("embedding")).alias("dim"),
        "ctime",
        F.col("last_access").alias("place"),
        F.lit(None).cast("string").alias("fp"),
    )
    meta = spark.range(1).select(F.lit(META_KEY).alias("key"), F.lit(fingerprint).alias("fp"))
    rows.unionByName(meta, allowMissingColumns=True).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").json(target)
    for number in _all(spark, path):
        if f"{path}/version={number}" != target and number not in before[-1:]:
            remove(spark, f"{path}/version={number}")


def _all(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, unfinished ones included."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    fs = made(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [n for n in _all(spark, path) if fs.exists(made(f"{path}/version={n}/_SUCCESS"))]


def read_snapshot(spark: SparkSession, path: str, fingerprint: str = "", max_entries: int | None = None, dim: int | None = None, multi_line: bool = False) -> DataFrame:
    """The entries of a snapshot, of its last whole version, newest ``max_entries`` only.

    Where the fingerprint differs from the expected one, vectors become null and texts stay.  Rows without a string
    key or value are skipped, and vectors that do not decode or have another length than ``dim`` are null.
    """
    versions = _versions(spark, path)
    raw = spark.read.schema(SCHEMA).option("multiLine", multi_line).json(f"{path}/version={versions[-1]}" if versions else path)
    found = raw.where(F.col("key") == META_KEY).agg(F.max("fp").alias("found_fp"))  # one row
    rows = raw.where(F.col("key").isNotNull() & F.col("value").isNotNull() & (F.col("key") != META_KEY)).crossJoin(F.broadcast(found))
    vector = F.coalesce(F.when(F.col("vec_b64").isNotNull(), decode_vector(F.col("vec_b64"), F.col("dim"))), F.col("embedding"))
    rows = rows.withColumn("vector", F.when(~fingerprint_differs(F.lit(fingerprint), F.col("found_fp")), vector))
    fits = F.size("vector") > 0 if dim is None else F.size("vector") == dim
    got = rows.select(
        "key",
        "value",
        F.col("src").alias("source"),
        "sse",
        F.when(fits, F.col("vector")).alias("embedding"),
        F.coalesce("ctime", F.lit(0)).alias("ctime"),
        F.coalesce("place", F.lit(0)).alias("last_access"),
    )
    if max_entries is None:
        return got
    return got.orderBy(F.desc("last_access"), "key").limit(max_entries)
