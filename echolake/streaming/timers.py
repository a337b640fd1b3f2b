"""Streams that fall silent and entries that grow old, ended by timers online.

State is kept by key and variable in Spark's state store, so a micro-batch writes what it changes and no more, however much
is held.  Timers are of event time: they go off when the watermark has passed them, in the same way after a restart from a checkpoint.
Both need the RocksDB state store, which :func:`use_rocksdb` chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need, for all streaming queries that the session starts afterwards."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _ms(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000


class _Idle(StatefulProcessor):
    """The last chunk of a stream, what came so far, and a timer for its silence."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "last long, chunks long, bytes long, ended boolean")

    def _row(self, key: tuple, how: str, at: int, chunks: int, size: int) -> pd.DataFrame:
        return pd.DataFrame({"stream_id": [key[0]], "outcome": [how], "at": [at], "chunks": [chunks], "bytes": [size]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, chunks, size, ended = self.open.get() if self.open.exists() else (None, 0, 0, False)
        if last is not None and not ended:
            self.handle.deleteTimer(last + self.idle_ms)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            if ended:  # what comes after its end belongs to no stream
                continue
            at = _ms(r.ts)
            if last is not None and at - last > self.idle_ms:
                ended = True
                out.append(self._row(key, "idle", last + self.idle_ms, chunks, size))
                continue
            last, chunks, size = max(at, last or at), chunks + 1, size + len((r.chunk or "").encode())
            if r.final:
                ended = True
                out.append(self._row(key, "ended", at, chunks, size))
        # an ended stream is remembered until nothing of it can come any more, which is when its timer goes off
        self.open.update((last, chunks, size, ended))
        self.handle.registerTimer(last + self.idle_ms)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            last, chunks, size, ended = self.open.get()
            self.open.clear()
            if not ended:
                yield self._row(key, "idle", last + self.idle_ms, chunks, size)

    def close(self) -> None:
        pass


def idle_aborts(chunks: DataFrame, idle_ms: int, late: str = "0 seconds") -> DataFrame:
    """One row for each stream of ``chunks`` (stream_id, seq, ts, chunk, final) when it ends: stream_id, outcome (``ended``, or ``idle`` after
    a silence of more than ``idle_ms``), at (milliseconds), chunks and bytes up to there.

    ``late`` is how long chunks may be under way; a silence is certain, and its timer goes off, when the watermark has passed it.
    """
    rows = chunks.withColumn("stream_id", F.col("stream_id").cast("string")).withWatermark("ts", late)
    schema = "stream_id string, outcome string, at long, chunks long, bytes long"
    return rows.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Idle(idle_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")


class _Lifetimes(StatefulProcessor):
    """When each entry of a namespace was written; a timer for each time at which some expire."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.born = handle.getMapState("born", "key string", "at long")
        self.due = handle.getMapState("due", "at long, key string", "there boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable").itertuples():
            at, k = _ms(r.ts), (r.key,)
            born = self.born.getValue(k)[0] if self.born.containsKey(k) else None
            live = born is not None and at - born < self.ttl_ms
            if r.op == "put":
                self._forget(r.key, born)
                self.born.updateValue(k, (at,))
                self.due.updateValue((at + self.ttl_ms, r.key), (True,))
                self.handle.registerTimer(at + self.ttl_ms)
                outcome = "replaced" if live else "stored"
            else:
                outcome = "hit" if live else "miss"
            out.append((key[0], int(r.seq), r.key, outcome, at))
        yield pd.DataFrame(out, columns=["namespace", "seq", "key", "outcome", "at"])

    def _forget(self, name: str, born: int | None) -> None:
        if born is not None:
            self.due.removeKey((born + self.ttl_ms, name))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        gone = [name for at, name in list(self.due.keys()) if at <= now]
        out = []
        for name in sorted(gone):
            born = self.born.getValue((name,))[0]
            self._forget(name, born)
            self.born.removeKey((name,))
            out.append((key[0], None, name, "purged", born + self.ttl_ms))
        if out:
            got = pd.DataFrame(out, columns=["namespace", "seq", "key", "outcome", "at"])
            got["seq"] = got["seq"].astype("Int64")
            yield got

    def close(self) -> None:
        pass


def entry_lifetimes(operations: DataFrame, ttl_ms: int, late: str = "0 seconds") -> DataFrame:
    """What becomes of each operation (namespace, seq, ts, op, key) on entries that live ``ttl_ms``, and a row when one is purged.

    A ``put`` is ``stored`` or, where the key lives, ``replaced``, which begins a new life; a ``get`` is a ``hit`` or a ``miss``.
    Expiry is decided by the operations' own times; what has expired leaves the state when the watermark has passed it
    (outcome ``purged``, without seq), so that the state holds what lives and no more.
    """
    rows = operations.withColumn("namespace", F.coalesce(F.col("namespace"), F.lit(""))).withWatermark("ts", late)
    schema = "namespace string, seq long, key string, outcome string, at long"
    return rows.groupBy("namespace").transformWithStateInPandas(statefulProcessor=_Lifetimes(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
