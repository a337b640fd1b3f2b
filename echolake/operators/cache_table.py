"""The answer cache as a table: lifetime, recency, eviction, upserts and index maintenance.

Entries have key, value, source, sse, embedding, ctime (seconds) and last_access (a rising number).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.keys import message_id, strip_namespace


def is_live(ctime: Column, now: Column, ttl: int) -> Column:
    """Whether an entry has not expired; with a ttl of 0 none does, and without a ctime it counts from 0."""
    return F.lit(True) if ttl == 0 else (now - F.coalesce(ctime, F.lit(0))) < ttl


def live(entries: DataFrame, now: int, ttl: int) -> DataFrame:
    return entries.where(is_live(F.col("ctime"), F.lit(now), ttl))


def contents(accesses: DataFrame, capacity: int, key: str = "key", seq: str = "seq") -> DataFrame:
    """What an LRU cache of ``capacity`` holds after all accesses: the most recently used keys, by place from 1."""
    last = accesses.groupBy(key).agg(F.max(seq).alias("last_access"))
    top = last.orderBy(F.desc("last_access"), key).limit(capacity)  # each task keeps its best before they meet
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("last_access"), key)))


def simulate(accesses: DataFrame, capacity: int, ttl: int = 0) -> DataFrame:
    """Every access of every cache with its outcome: hit, miss or expired, and whether it evicted an entry.

    ``accesses`` has cache, seq, key and now; a miss fills.  Rows of a cache are streamed in order through one ordered
    map, which holds at most ``capacity`` keys.
    """
    schema = "cache string, seq long, key string, outcome string, evicted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, held = None, OrderedDict()
        for b in batches:
            names, seqs, keys, nows = (c.to_pylist() for c in b.columns)
            outcomes, evicted = [], []
            for name, key, now in zip(names, keys, nows):
                if name != cache:
                    cache, held = name, OrderedDict()
                born = held.get(key)
                if born is not None and ttl and now - born >= ttl:
                    del held[key]
                    outcome = "expired"
                else:
                    outcome = "miss" if born is None else "hit"
                full = False
                if outcome == "hit":
                    held.move_to_end(key)
                else:
                    while len(held) >= capacity:
                        held.popitem(last=False)
                        full = True
                    held[key] = now
                outcomes.append(outcome)
                evicted.append(full)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(outcomes), pa.array(evicted)], names=["cache", "seq", "key", "outcome", "evicted"])

    rows = accesses.select(F.coalesce(F.col("cache").cast("string"), F.lit("")).alias("cache"), F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("now").cast("long").alias("now"))
    return rows.repartition("cache").sortWithinPartitions("cache", "seq").mapInArrow(run, schema)


def store_counters(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    return outcomes.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("hit", "hits"), ("miss", "misses"), ("expired", "expired"))], F.count_if("evicted").alias("evictions"))


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries after ``changes`` (same columns, with rising last_access): the last value, ctime and vector win; the
    source is kept unless one is given."""
    both = entries.select(*entries.columns).unionByName(changes.select(*entries.columns))
    others = [c for c in entries.columns if c not in ("key", "source")]
    return both.groupBy("key").agg(*[F.max_by(c, "last_access").alias(c) for c in others], F.max_by("source", F.when(F.col("source").isNotNull(), F.col("last_access"))).alias("source")).select(*entries.columns)


def next_id(entries: DataFrame, floor: int = 0) -> DataFrame:
    """One row: one more than the largest N of the live ``msg:N`` keys, never less than ``floor``."""
    return entries.agg(F.greatest(F.coalesce(F.max(message_id(F.col("key"))) + 1, F.lit(0)), F.lit(floor)).alias("next_id"))


def rebuild(entries: DataFrame, embed, now: int, ttl: int, dim: int) -> DataFrame:
    """The next version of the table: live entries, those without a fitting vector encoded again from their source.

    ``embed`` is a column function from text to array<float>; it runs on those rows only.
    """
    rows = live(entries, now, ttl).withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")))
    has = rows.where("embedding is not null")
    lacks = rows.where("embedding is null")
    again = lacks.withColumn("embedding", F.when(F.col("source").isNotNull(), embed(strip_namespace(F.col("source")))))
    return has.unionByName(again)


def ghosts(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Searches (query_id, key of the nearest vector) and whether that entry is gone."""
    return found.join(entries.select("key", F.lit(True).alias("_there")), "key", "left").select("query_id", "key", F.col("_there").isNull().alias("is_ghost"))
