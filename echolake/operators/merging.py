"""Merging of requests that are in flight at the same time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolake.functions.entities import entity_tokens
from echolake.functions.vectors import EPSILON
from echolake.operators.retrieval import CELLS, _matrix

SEMANTIC = 0.95
PIVOTS = 64  # at most; broadcast
SAMPLE = 5_000  # rows that pivots are chosen from
BLOCK = 8_192  # rows of either side that one task compares
ROWS = 256  # that a task copies to cells at a time
SLICE = 4_096  # rows of a time slice, on average at least


def merge_exact(requests: DataFrame, width: float) -> DataFrame:
    """request_id and the earliest request with the same key in whose flight it began.

    ``requests`` has request_id, key, started and ended (seconds).  A key is swept in time slices of ``width`` seconds, by the
    start of a flight at first: only a flight that outlasts all before it can lead, and of these both starts and ends rise.  So
    a request's leader is the one that ends next after it began, which is sought from the slice of its start on, among leads
    by the slices of their ends.  What a slice needs of others is one row a slice: the longest flight before it, the next end
    after it.  So ``width`` sets how much a task sorts, nothing else, and no flight is written twice however long it lasts.
    """
    rows = requests.select("request_id", "key", "started", "ended").where("started is not null")
    slice_of = lambda c: F.floor(F.col(c) / width)
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("key").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)

    flights = rows.where("started < ended").withColumn("slice", slice_of("started"))
    reached = flights.groupBy("key", "slice").agg(F.max("ended").alias("most")).select(F.col("key").alias("k"), F.col("slice").alias("s"), F.max("most").over(earlier).alias("before"))
    inside = Window.partitionBy("key", "slice").orderBy("started", "request_id").rowsBetween(Window.unboundedPreceding, -1)
    known = flights.withColumn("longest", F.max("ended").over(inside)).join(reached, F.col("key").eqNullSafe(F.col("k")) & (F.col("slice") == F.col("s")))
    leads = known.where(F.coalesce(F.col("ended") > F.greatest("longest", "before"), F.lit(True)))

    lead = F.struct("request_id", "started")
    ends = leads.select("key", slice_of("ended").alias("slice"), F.col("ended").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["request_id"].dataType).alias("request_id"), lead.alias("lead"))
    asks = rows.select("key", slice_of("started").alias("slice"), F.col("started").alias("at"), F.lit(1).alias("kind"), "request_id", F.lit(None).cast(ends.schema["lead"].dataType).alias("lead"))
    events = ends.unionByName(asks)
    # from the last event back; an end at the very time of a request comes after it there, and so does not lead it
    back = Window.partitionBy("key", "slice").orderBy(F.desc("at"), F.desc("kind"), F.desc("request_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = events.withColumn("next", F.last("lead", ignorenulls=True).over(back)).where("kind = 1")
    firsts = events.groupBy("key", "slice").agg(F.min_by("lead", F.when(F.col("kind") == 0, F.col("at"))).alias("first"))
    firsts = firsts.select(F.col("key").alias("k"), F.col("slice").alias("s"), F.last("first", ignorenulls=True).over(later).alias("after"))
    got = asked.join(firsts, F.col("key").eqNullSafe(F.col("k")) & (F.col("slice") == F.col("s"))).withColumn("next", F.coalesce("next", "after"))
    return got.where(F.col("next.started") < F.col("at")).select("request_id", F.col("next.request_id").alias("leader_id"))


def pivots(rows: DataFrame, many: int, sample: int = SAMPLE, threshold: float | None = None) -> np.ndarray:
    """At most ``many`` unit vectors far apart, chosen one after the other from a sample of the vectors of the commonest length.

    With a ``threshold``, as many of the first of them as are worth the copies that a vector has in their cells: these are a quarter of
    the cells at most, on the sample's average, or there is one cell.
    """
    some = rows.where(F.size("embedding") > 0)
    common = some.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return np.zeros((0, 0))
    place = F.xxhash64("request_id")
    drawn = some.where(F.size("embedding") == common["dim"]).orderBy(place, "request_id").limit(sample).select("embedding").collect()
    x = _unit(np.array([r["embedding"] for r in drawn], dtype=np.float64))
    chosen, nearest = [0], np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(many, len(x)) and nearest.max() > 1e-9:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(x - x[chosen[-1]], axis=1))
    while threshold is not None and len(chosen) > 1 and 4 * _reached(x, x[chosen], threshold)[1].sum() > len(x) * len(chosen):
        chosen = chosen[: len(chosen) // 2]
    return x[chosen]


def _reached(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors, the cell of each and which cells can hold a vector so similar to it (see :func:`_celled`)."""
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    between = np.linalg.norm(c[:, None] - c[None], axis=2)
    near = np.maximum(0, 2 - 2 * (x @ c.T)) + 1e-12
    if (flat := np.linalg.norm(x, axis=1) < 0.5).any():
        near[flat] = 1.0  # a vector of zeros is in every cell
    own = near.argmin(1)
    return own, near - near[np.arange(len(x)), own][:, None] <= 2 * between[own] * radius + 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + EPSILON)


def _celled(rows: DataFrame, centres: np.ndarray, threshold: float, copies: bool) -> DataFrame:
    """``rows`` with ``cell``, that of the nearest pivot; with ``copies`` in every cell besides that can hold a vector so similar.

    Unit vectors of a cosine of at least t are within r = sqrt(2 - 2t).  A vector whose distances to its own pivot p and to
    another q are a and b is at least (b*b - a*a) / (2 |pq|) from any vector nearer to q, so a cell beyond r is left out.
    Vectors of another length than the pivots, or of none, are cells of their own.
    """
    held, at, dims = rows.sparkSession.sparkContext.broadcast(centres), rows.columns.index("embedding"), centres.shape[1] if len(centres) else -1
    schema = rows.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            sizes = pa.compute.fill_null(pa.compute.list_value_length(b.column(at)), -1).to_numpy()
            odd = np.flatnonzero(sizes != dims)
            row, cell = odd, -1 - sizes[odd].astype(np.int64)
            fits = np.flatnonzero(sizes == dims)
            if len(fits):
                own, reach = _reached(_unit(_matrix(b.column(at).take(pa.array(fits)))), c, threshold)
                at_row, at_cell = np.nonzero(reach) if copies else (np.arange(len(fits)), own)
                row, cell = np.concatenate([row, fits[at_row]]), np.concatenate([cell, at_cell])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, pa.array(cell.astype(np.int32))], names=schema.names)

    return rows.mapInArrow(run, schema)


def merge_semantic(requests: DataFrame, width: float, threshold: float = SEMANTIC, veto: bool = True, many: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """As :func:`merge_exact` for similar texts of one namespace; the leader is the earliest, which settles ties.

    ``requests`` also has namespace, text and embedding.  Rows meet by namespace, by their entities (which must be equal, unless
    ``veto`` is false), by time slices of ``width`` seconds (or more) and by the cells of pivots, so that only what can reach the threshold is
    compared.  A flight is in its own cell and in all slices that it lasts; a request is in its own slice and in all cells
    that it can reach.  Crowded groups are dealt to parts of at most ``block`` rows of either side, whose products are
    matrices, and a part gives a request's earliest leader alone, never pairs.
    """
    spark = requests.sparkSession
    entities = F.to_json(entity_tokens(F.col("text"))) if veto else F.lit("")
    rows = requests.where("embedding is not null and started is not null").select("request_id", F.coalesce("namespace", F.lit("")).alias("namespace"), entities.alias("entities"), F.col("started").cast("double").alias("started"), F.col("ended").cast("double").alias("ended"), F.col("embedding").cast("array<float>").alias("embedding"))
    centres = pivots(rows, many, threshold=threshold)
    # one row; slices are at least as wide as flights last on average, so that these are a few rows each, whatever ``ended`` says, and
    # hold SLICE rows on average, as a group costs more than the pairs of few rows
    first, last, many_rows, lasting = rows.agg(F.min("started"), F.max("started"), F.count("*"), F.avg(F.when(F.col("started") < F.col("ended"), F.col("ended") - F.col("started")))).first()
    width = max(width, min(lasting or 0.0, 1e300), min(((last or 0.0) - (first or 0.0)) * SLICE / max(1, many_rows), 1e300))
    slice_of = lambda c: F.floor(c / width)
    early = rows.where("started < ended").withColumn("slice", F.explode(F.sequence(slice_of(F.col("started")), slice_of(F.least(F.col("ended"), F.lit(last))))))
    early = _celled(early, centres, threshold, False)
    late = _celled(rows.withColumn("slice", slice_of(F.col("started"))), centres, threshold, True)

    keys = ["namespace", "entities", "slice", "cell"]
    # a row a group that has both sides
    n = early.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("n"))
    m = late.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("m"))
    parts = n.join(m, keys)
    again = parts.select(*[F.col(c).alias(c) for c in parts.columns])  # columns of its own for the other side
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = late.join(parts, keys).withColumn("mine", F.pmod(F.xxhash64("request_id"), F.col("m"))).withColumn("theirs", every("n"))
    right = early.join(again, keys).withColumn("theirs", F.pmod(F.xxhash64("request_id"), F.col("n"))).withColumn("mine", every("m"))
    schema = rows.select("request_id", F.col("request_id").alias("leader_id"), F.col("started").alias("leader_started")).schema

    def find(asks: pa.Table, flights: pa.Table) -> pa.Table:
        out = [[], []]
        if len(asks) and len(flights):
            flights = flights.sort_by([("started", "ascending"), ("request_id", "ascending")])
            x, y = (_matrix(t.column("embedding").combine_chunks()) for t in (asks, flights))
            at, begun, ended = (t.column(c).to_numpy() for t, c in ((asks, "started"), (flights, "started"), (flights, "ended")))
            nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            step = max(1, CELLS // len(y))
            for s in range(0, len(x), step):
                now = at[s : s + step, None]
                cosines = np.clip(x[s : s + step] @ y.T / (nx[s : s + step, None] * ny[None] + EPSILON), -1, 1)
                good = (cosines >= threshold) & (begun[None] < now) & (now < ended[None])
                found = np.flatnonzero(good.any(1))
                out[0].extend((s + found).tolist())
                out[1].extend(good[found].argmax(1).tolist())
        ask, lead = asks.take(pa.array(out[0], pa.int64())), flights.take(pa.array(out[1], pa.int64()))
        return pa.table({"request_id": ask.column("request_id"), "leader_id": lead.column("request_id"), "leader_started": lead.column("started")})

    by = [*keys, "mine", "theirs"]
    best = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(find, schema)
    return best.groupBy("request_id").agg(F.min_by("leader_id", F.struct("leader_started", "leader_id")).alias("leader_id"))


def merge(requests: DataFrame, width: float, threshold: float = SEMANTIC) -> DataFrame:
    """The exact leader where there is one, else the semantic one; null for requests that lead themselves."""
    exact = merge_exact(requests, width).withColumnRenamed("leader_id", "exact")
    semantic = merge_semantic(requests, width, threshold).withColumnRenamed("leader_id", "semantic")
    both = requests.select("request_id").join(exact, "request_id", "left").join(semantic, "request_id", "left")
    return both.select("request_id", F.coalesce("exact", "semantic").alias("leader_id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("semantic").isNotNull(), "semantic").alias("merged_by"))
