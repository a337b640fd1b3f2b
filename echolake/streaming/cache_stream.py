"""The cache and the merging of requests online, with state per namespace."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echolake.functions.vectors import EPSILON


def exact_cache(requests: DataFrame, capacity: int, ttl: int = 0) -> DataFrame:
    """Every request (namespace, seq, key, now) with hit, miss or expired; a miss fills.

    State per namespace is the ordered map of at most ``capacity`` keys; expiry is decided by the requests' own times.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict(zip(*state.get)) if state.exists else OrderedDict()
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for k, now in zip(rows["key"], rows["now"].tolist()):
            born = held.get(k)
            if born is not None and not (ttl and now - born >= ttl):
                held.move_to_end(k)
                out.append("hit")
                continue
            out.append("miss" if born is None else "expired")
            held.pop(k, None)
            while len(held) >= capacity:
                held.popitem(last=False)
            held[k] = now
        state.update((list(held.keys()), list(held.values())))
        yield pd.DataFrame({"namespace": key[0], "seq": rows["seq"].to_numpy(), "key": rows["key"].to_numpy(), "outcome": out})

    return requests.groupBy("namespace").applyInPandasWithState(run, "namespace string, seq long, key string, outcome string", "keys array<string>, born array<long>", "append", GroupStateTimeout.NoTimeout)


class Singleflight:
    """Requests in flight in one namespace.  A new leader of a key displaces the old one, and only an owner ends its flight."""

    def __init__(self, threshold: float = 0.95, flights: list | None = None):
        self.threshold = threshold
        self.flights: OrderedDict[str, dict] = OrderedDict((f["key"], f) for f in flights or [])

    def find(self, key: str, vector, entities: list) -> tuple[int, str] | None:
        """The leader to wait for and how it was found: the same key first, else the earliest similar flight."""
        if key in self.flights:
            return self.flights[key]["owner"], "exact"
        v = np.asarray([] if vector is None else vector, dtype=np.float64)
        for f in sorted(self.flights.values(), key=lambda f: f["owner"]):
            w = np.asarray(f["vector"], dtype=np.float64)
            if len(v) and len(w) == len(v) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w) + EPSILON) >= self.threshold and f["entities"] == entities:
                return f["owner"], "semantic"
        return None

    def lead(self, owner: int, key: str, vector, entities: list) -> None:
        self.flights[key] = {"key": key, "owner": owner, "vector": [] if vector is None else [float(x) for x in vector], "entities": entities}

    def end(self, owner: int, key: str) -> bool:
        """Whether ``owner`` still led ``key``; a stale owner changes nothing."""
        if key in self.flights and self.flights[key]["owner"] == owner:
            del self.flights[key]
            return True
        return False


def singleflight(operations: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Operations (namespace, seq, op, request_id, key, embedding, entities) on the table of flights, in order.

    ``op`` is ``begin`` (joins a flight or leads one) or ``end``.  Outcomes: merged (with leader and how), leader,
    completed, stale.  ``entities`` is an array of strings.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        table = Singleflight(threshold, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            entities = sorted(r.entities) if r.entities is not None else []
            if r.op == "begin":
                found = table.find(r.key, r.embedding, entities)
                if found is None:
                    table.lead(int(r.request_id), r.key, r.embedding, entities)
                out.append((int(r.seq), int(r.request_id), "leader", None, None) if found is None else (int(r.seq), int(r.request_id), "merged", found[0], found[1]))
            else:
                out.append((int(r.seq), int(r.request_id), "completed" if table.end(int(r.request_id), r.key) else "stale", None, None))
        state.update((json.dumps(list(table.flights.values())),))
        got = pd.DataFrame(out, columns=["seq", "request_id", "outcome", "leader_id", "merged_by"])
        got["leader_id"] = got["leader_id"].astype("Int64")
        got.insert(0, "namespace", key[0])
        yield got

    return operations.groupBy("namespace").applyInPandasWithState(run, "namespace string, seq long, request_id long, outcome string, leader_id long, merged_by string", "flights string", "append", GroupStateTimeout.NoTimeout)


COMPACT = 32  # micro-batches between two full versions of a maintained table


def _folders(spark, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``<kind>=<number>`` that are complete."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(at) if fs.exists(at) else []
    names = [f.getPath().getName() for f in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def current(spark, entries_path: str, schema, upsert, before: int | None = None) -> DataFrame:
    """The entries of a maintained table: its last full version and the changes since, merged as they are read.

    ``before`` leaves out full versions from that number on.
    """
    whole = [n for n in _folders(spark, entries_path, "whole") if before is None or n < before]
    since = [n for n in _folders(spark, entries_path, "changes") if not whole or n > whole[-1]]
    base = spark.read.schema(schema).parquet(f"{entries_path}/whole={whole[-1]}") if whole else spark.createDataFrame([], schema)
    return upsert(base, spark.read.schema(schema).parquet(*[f"{entries_path}/changes={n}" for n in since])) if since else base


def maintain(entries_path: str, changes: DataFrame, checkpoint: str, now, ttl: int, upsert, interval: str | None = None, compact: int = COMPACT):
    """Apply a stream of changes to the table of entries, which :func:`current` reads.

    A micro-batch writes its own changes only (``changes=<batch>``), so it costs what it brings; every ``compact`` batches a
    full version (``whole=<batch>``) is written from the one before and the changes since, without what has expired, and
    what neither it nor its predecessor needs goes.  A batch that is repeated writes its folders again, so a restart changes
    nothing.  ``now`` is a function of the batch's number, ``upsert`` merges entries and changes.  Without ``interval`` all that
    is there is taken, in as many batches as needed, and the query ends.
    """
    from echolake.operators.cache_table import live

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{entries_path}/changes={number}")
        if number % compact != compact - 1:
            return
        last = [n for n in _folders(spark, entries_path, "whole") if n < number][-1:]
        live(current(spark, entries_path, batch.schema, upsert, before=number), now(number), ttl).write.mode("overwrite").parquet(f"{entries_path}/whole={number}")
        for n in last:  # readers may still be at the last version
            old = [f"whole={k}" for k in _folders(spark, entries_path, "whole") if k < n] + [f"changes={k}" for k in _folders(spark, entries_path, "changes") if k <= n]
            for name in old:
                gone = spark._jvm.org.apache.hadoop.fs.Path(f"{entries_path}/{name}")
                gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def tick(entries: DataFrame, log: DataFrame, searches: DataFrame, embed, now: int, ttl: int, dim: int, snapshot_path: str, fingerprint: str) -> dict:
    """One round of maintenance: the report of ``log``, whether the share of ghosts among ``searches`` (is_ghost) calls for a new
    index, and the live entries, with vectors made again if so, saved as a snapshot.

    Returns ``line`` (null without traffic), ``ghost_percent``, ``rebuild``, ``purged`` and ``kept``: a few numbers.
    """
    from echolake.operators.cache_table import live, rebuild
    from echolake.operators.metrics import counters, ghost_rate
    from echolake.sources.reports import summary
    from echolake.sources.snapshot import write_snapshot

    line, ghosts = summary(counters(log)).first(), ghost_rate(searches).first()
    before, after = entries.count(), live(entries, now, ttl).count()
    due = bool(ghosts["rebuild"]) or after < before  # what was purged is still in the index
    if after:
        write_snapshot(rebuild(entries, embed, now, ttl, dim) if due else live(entries, now, ttl), snapshot_path, fingerprint, now, ttl)
    return {"line": line and line["line"], "ghost_percent": ghosts["ghost_percent"], "rebuild": due, "purged": before - after, "kept": after}


def windowed_counts(log: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """An extension: outcomes by event-time window, with a watermark for late rows."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "outcome").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency_ms"))
