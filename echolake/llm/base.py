"""Helpers that the training-data operators share: inputs, shared storage, hold-out folds."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset and the session is local, as in tests, a temporary folder takes its place; on a cluster an
    unset value is an error, since a machine-local folder would lose what other executors wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_written: set[str] = set()  # folders that this process asked for and has not removed


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


@contextmanager
def swept(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Removes at its end what operators stored since its start, but for ``keep``: for callers that have written the result."""
    before = set(_written)
    try:
        yield
    finally:
        for path in _written - before - set(keep):
            delete(spark, path)


def materialize(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and it gives later joins a
    plain scan on this side, which lets adaptive execution split skewed partitions.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._stored_at = path
    return got


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`materialize` wrote for tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder in whatever file system holds it."""
    _written.discard(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows that a task turns into Python objects at once.
SLICE = 512


def slices(batches):
    """Arrow batches in pieces of at most SLICE rows, without copying: texts as Python objects are held for one piece."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE):
            yield b.slice(i, SLICE)


def tidy(run):
    """``run`` for mapInArrow, which gives memory back to the system when a task ends: workers live on between tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


_BLOOM_BITS = 1 << 28  # at most: 32 MB, enough for 16 million ids at 16 bits each; more ids only let more rows through
_BLOOM_CHUNK = 1 << 16  # bits that one row of the aggregate holds


def maybe_in(df: DataFrame, column: str, ids: DataFrame, keep: bool = True, most_bits: int = _BLOOM_BITS) -> DataFrame:
    """The rows of ``df`` whose ``column`` may be among ``ids`` (with ``keep`` false: those for which it surely is not).

    ``ids`` has one column of integers.  A Bloom filter is sized by their number, built in chunks by the executors and
    broadcast, so that a join with ``ids`` that follows shuffles few rows that it would drop.  It has ``most_bits`` at most;
    with more ids than that holds the same rows come out of the join, after a larger shuffle.  Null is not among ids.
    """
    name = ids.columns[0]
    wanted = 16 * max(1, ids.count())
    bits = min(most_bits, 1 << max(10, (wanted - 1).bit_length()))
    chunk = min(bits, _BLOOM_CHUNK)

    def places(c: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in range(4)]

    def fill(batches):
        last, held = None, np.zeros(chunk // 8, dtype=np.uint8)
        for b in batches:
            at = b.column(0).to_numpy()
            for k in np.unique(at).tolist():
                if k != last:
                    if last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "bits"])
                    last, held = k, np.zeros(chunk // 8, dtype=np.uint8)
                p = b.column(1).to_numpy()[at == k]
                np.bitwise_or.at(held, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["chunk", "bits"])

    bit = F.explode(F.array(*places(F.col(name).cast("long"))))
    set_bits = ids.where(F.col(name).isNotNull()).select(bit.alias("p")).select(F.expr(f"p div {chunk}").alias("chunk"), F.expr(f"int(p % {chunk})").alias("p"))
    filled = set_bits.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tidy(fill), "chunk long, bits binary").toArrow()
    table = np.zeros(bits // 8, dtype=np.uint8)
    for k, v in zip(filled.column(0).to_pylist(), filled.column(1).to_pylist()):
        table[k * (chunk // 8) : (k + 1) * (chunk // 8)] = np.frombuffer(v, dtype=np.uint8)
    held, columns = df.sparkSession.sparkContext.broadcast(table), df.columns

    def run(batches):
        for b in batches:
            inside = np.array(b.column(len(columns)).is_valid())
            for k in range(1, 5):
                p = b.column(len(columns) + k).to_numpy()
                inside &= (held.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 != 0
            yield pa.RecordBatch.from_arrays(b.columns[: len(columns)], names=columns).filter(pa.array(inside if keep else ~inside))

    # numbered names, so that no column of df clashes with the places
    plain = df.toDF(*[f"c{k}" for k in range(len(columns))])
    c = F.col(f"c{columns.index(column)}").cast("long")
    return plain.select("*", c.alias("id"), *[x.alias(f"p{k}") for k, x in enumerate(places(c))]).mapInArrow(tidy(run), df.schema)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(df: DataFrame, n: int, place: Column, *order: Column, total: int | None = None) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest ``place`` (a 64-bit hash): a bounded sample that does not depend on layout.

    Rows are counted first (unless ``total`` is known), and only about twice as many as wanted pass a test of their hash, so
    that not every task sends ``n`` rows to where they are ordered.
    """
    total = df.count() if total is None else total
    wanted = 2 * n + 1000
    some = df if total <= wanted else df.where(place < -(1 << 63) + (1 << 64) * wanted // total)
    return some.orderBy(place, *order).limit(n)
