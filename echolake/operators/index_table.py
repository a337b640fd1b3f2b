"""A vector index as a table of versions, kept up by change sets and replaced as a whole.

A version is a manifest: a small numbered file that names a base folder and the change sets that came after it.  Folders are
written first and never changed; then the manifest is put in place by one rename, which fails if another writer was first, who is then
built upon.  So a reader, who takes the highest manifest when the plan is made, sees a whole version and goes on reading
it whatever happens meanwhile, and what a writer that died has left behind is seen by nobody and removed by :func:`vacuum`.

A rebuild starts from the entries of one version and may take long.  Change sets that come meanwhile aren't lost: the manifest
that it puts in place names all that the version of its start did not have.

Rows are key and embedding, and whatever other columns the entries have; change sets also have ``deleted``, and ``seq``, by which of
several changes of one key the last one counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from echolake.storage import remove


class Conflict(RuntimeError):
    """Another writer has put a manifest of this number in place."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def manifests(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, in order."""
    return sorted(int(n.removeprefix("manifest-")) for n in _names(spark, path) if n.startswith("manifest-"))


def manifest(spark: SparkSession, path: str, number: int | None = None) -> dict | None:
    """The manifest of a version, by default the last: number, base and changes; null if there is none."""
    number = number if number is not None else max(manifests(spark, path), default=None)
    if number is None:
        return None
    fs, at = _fs(spark, f"{path}/manifest-{number:012d}")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, held: dict) -> None:
    fs, draft = _fs(spark, f"{path}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(json.dumps(held).encode())
    stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-{held['number']:012d}")
    # some file systems rename onto a file that is there
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {held['number']} of {path} is there already")


def _publish(spark: SparkSession, path: str, change) -> dict:
    """Puts the manifest in place that ``change`` makes of the last one, again if another writer was first."""
    while True:
        last = manifest(spark, path)
        held = change(last or {"number": -1, "base": None, "changes": []}) | {"number": (last["number"] if last else -1) + 1}
        try:
            _swap(spark, path, held)
            return held
        except Conflict:
            continue


def _write(df: DataFrame, path: str, kind: str) -> str:
    name = f"{kind}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    return name


def read(spark: SparkSession, path: str, schema: StructType, number: int | None = None) -> DataFrame:
    """The entries of a version, by default the last; none if there is no version."""
    held = manifest(spark, path, number)
    changed = StructType([*schema.fields]).add("deleted", "boolean").add("seq", "long")
    part = lambda name, place: spark.read.schema(changed).parquet(f"{path}/{name}").withColumn("_place", F.lit(place))
    base = spark.read.schema(schema).parquet(f"{path}/{held['base']}") if held and held["base"] else spark.createDataFrame([], schema)
    if not held or not held["changes"]:
        return base
    rows = base.withColumns({"deleted": F.lit(False), "seq": F.lit(0).cast("long"), "_place": F.lit(-1)})
    for place, name in enumerate(held["changes"]):
        rows = rows.unionByName(part(name, place))
    others = [c for c in schema.names if c != "key"]
    last = rows.groupBy("key").agg(F.max_by(F.struct(*others, "deleted"), F.struct("_place", "seq")).alias("r"))
    return last.where(~F.coalesce("r.deleted", F.lit(False))).select(*[F.col("key") if c == "key" else F.col(f"r.{c}").alias(c) for c in schema.names])


def apply(path: str, changes: DataFrame) -> dict:
    """A version with one change set more: the cost of what it brings."""
    name = _write(changes, path, "changes")
    return _publish(changes.sparkSession, path, lambda last: {"base": last["base"], "changes": [*last["changes"], name]})


def rebuild(spark: SparkSession, path: str, schema: StructType, make) -> dict:
    """A version whose base is what ``make`` makes of the last one's entries, and the change sets that came meanwhile."""
    begun = manifest(spark, path) or {"number": -1, "changes": []}
    name = _write(make(read(spark, path, schema, begun["number"]) if begun["number"] >= 0 else spark.createDataFrame([], schema)).select(*schema.names), path, "base")
    known = set(begun["changes"])
    return _publish(spark, path, lambda last: {"base": name, "changes": [c for c in last["changes"] if c not in known]})


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes all versions but the last ``keep``, and folders that none of these names; only while no writer is at work."""
    numbers = manifests(spark, path)
    held = [manifest(spark, path, n) for n in numbers[-keep:]]
    needed = {n for m in held for n in [m["base"], *m["changes"]]} | {f"manifest-{n:012d}" for n in numbers[-keep:]}
    gone = [n for n in _names(spark, path) if n not in needed]
    for n in gone:
        remove(spark, f"{path}/{n}")
    return gone
