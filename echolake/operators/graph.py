"""Nearest neighbours by a graph that is a table.

A row of the graph is a vector with its neighbours' ids and vectors, so that a step of a search is one join.

Building.  Each vector goes to the few cells that it is nearest to, and takes the nearest of all it meets there as first neighbours; of a
cell, they are a matrix product.  How many of the true neighbours that finds is measured on a sample of vectors.  While it is too few,
rounds improve them: the neighbours of a vector, those that name it included, are probably near each other, so every vector introduces
all of them to each other, and each keeps the best it has met.  Rounds end when few neighbours change, too.  At last each vector's
candidates are thinned out from the nearest on: one that is nearer to a neighbour kept before than to the vector itself is left out, for it is
reached through that neighbour; free places are filled with the nearest of those.

Above the graph of all vectors are those of ever smaller samples, each a quarter of the one below, down to a bounded one.  They
lead between crowds of vectors whose nearest neighbours are all of the same crowd.

Searching.  A query begins at the best of the smallest sample and holds a beam of the best vectors met so far.  In every round it
asks for the neighbours of the best of these that it has not asked yet; one join by buckets of vectors answers all queries.  When it has asked for all
of its beam it goes on in the graph below, where the beam is its beginning.  A query is one row, with its beam in arrays, and so are
what it asks of a bucket and the answer; queries that have asked for all take no part in further rounds.

An outlier that no vector names is not found; how many there are shows in the recall, which is to be measured.

A fixed beam finds ever less of a growing store, so :func:`tune` measures on a sample of queries which one reaches the wanted recall.

No task holds more than a cell's block, a vector's neighbours, the lists or beams of a bounded number of vectors or queries, or a bucket
of vectors with their neighbours and about :data:`REQUESTS` requests to them: of those that name a popular vector the nearest are heard,
and requests to a crowded bucket are dealt to parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolake.operators import ann
from echolake.operators.retrieval import CELLS, DECIMALS, _matrix, knn, recall_with_ties, top_k
from echolake.storage import checkpointed

DEGREE = 32  # neighbours of a vector
CELL = 16_384  # vectors in a cell, about
MEET = 2  # cells that a vector goes to
LISTS = 0.7  # share of the true neighbours that a sample must have, or rounds follow
SAMPLE = 500  # vectors of that sample
ROUNDS = 6  # at most
STILL = 0.01  # building ends when a round changes a smaller share of all neighbours
ENTRIES = 4_096  # vectors that a search may begin at; broadcast
SHRINK = 4  # times as many vectors are in a layer as in the one above
BEAM, WIDTH = 96, 24  # vectors that a query holds, and of how many it asks in a round
BUCKET = 2_048  # vectors whose neighbours a task of a search holds at once, about
REQUESTS = 1 << 16  # queries that ask them, whom it answers
HELD = 1 << 17  # neighbours, or members of beams, that a task merges at once, about
ASKED = 4_096  # of which so many at a time

_LIST = "node long, others array<long>, similarities array<double>"


def _unit(column: pa.Array) -> np.ndarray:
    x = _matrix(column)
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists of a column, and of which row each is."""
    column = column.combine_chunks()
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False)


def _lists(row: np.ndarray, many: int, *values: np.ndarray) -> list[pa.ListArray]:
    """The opposite: ``many`` lists, of values sorted by row."""
    offsets = pa.array(np.searchsorted(row, np.arange(many + 1)), pa.int32())
    return [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in values]


def _ranked(row: np.ndarray, ids: np.ndarray, similarity: np.ndarray, new: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """The ``most`` most similar of each row, sorted; of an id that comes more than once the first is it."""
    known, place = np.unique(ids, return_inverse=True)
    key = row * len(known) + place
    order = np.argsort(key, kind="stable")
    key = key[order]
    once = np.ones(len(key), dtype=bool)
    once[1:] = key[1:] != key[:-1]
    order = order[once]
    far = np.rint((2 - similarity[order]) * 10.0**DECIMALS).astype(np.int64)  # whole, for similarities are rounded
    order = order[np.argsort((row[order] << 23) + far, kind="stable")]
    row = row[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < most
    order = order[kept]
    return row[kept], ids[order], similarity[order], new[order]


def _merged(lists: DataFrame, degree: int, nodes: int) -> DataFrame:
    """One list a node, of the ``degree`` most similar of its lists, and how many of them are only in lists that are ``new``."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("new")  # what a node has counts before what it meets
        node, of = np.unique(t.column("node").to_numpy(), return_inverse=True)
        at, others = _flat(t.column("others"))
        new = t.column("new").to_numpy()[at]
        row, others, similarity, new = _ranked(of[at], others, _flat(t.column("similarities"))[1], new, degree)
        held = _lists(row, len(node), others, similarity)
        return pa.table({"node": node, "others": held[0], "similarities": held[1], "fresh": np.bincount(row[new], minlength=len(node))})

    block = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(max(1, -(-nodes * 2 * degree // HELD))))
    return lists.withColumn("block", block).groupBy("block").applyInArrow(merge, _LIST + ", fresh long")


def _edges(lists: DataFrame) -> DataFrame:
    """node, other and similarity."""
    each = lists.select("node", F.explode(F.arrays_zip("others", "similarities")).alias("e"))
    return each.select("node", F.col("e.others").alias("other"), F.col("e.similarities").alias("similarity"))


def _grouped(df: DataFrame, key: str, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``work`` on all rows of each value of ``key``, of which there are few; a task streams through its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            keys = b.column(b.schema.get_field_index(key)).to_numpy()
            borders = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for i, j in zip(borders, borders[1:]):
                if j == i:
                    continue
                part = b.slice(i, j - i)
                if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[i]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from work(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _best_of(edges: DataFrame, degree: int, by: str = "node") -> DataFrame:
    """The ``degree`` most similar of each ``by``; the limit is applied before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("similarity"), "node", "other"))
    return edges.withColumn("_place", place).where(F.col("_place") <= degree).drop("_place")


def _nearest(similarity: np.ndarray, many: int) -> np.ndarray:
    return np.argpartition(similarity, similarity.shape[1] - max(1, many), axis=1)[:, similarity.shape[1] - many :]


def _first(nodes: DataFrame, total: int, degree: int, cell: int) -> DataFrame:
    """The nearest of all that each vector meets in the cells nearest to it, or in parts of crowded ones."""
    held = nodes.sparkSession.sparkContext.broadcast(ann.centres(nodes, max(1, total * MEET // cell)))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            if b.num_rows:
                cells = _nearest(_unit(b.column(1)) @ c.T, min(MEET, len(c)))
                each = b.take(pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*each.columns, pa.array(cells.ravel().astype(np.int32))], names=["vec_id", "embedding", "cell"])

    celled = nodes.mapInArrow(route, "vec_id long, embedding array<float>, cell int")
    parts = celled.groupBy("cell").agg(F.ceil(F.count("*") / (4 * cell)).alias("parts"))  # a row a cell
    dealt = celled.join(F.broadcast(parts), "cell").select(F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id", "cell", F.lit(5)), F.col("parts"))).alias("part"), "vec_id", "embedding")

    def near(t: pa.Table) -> pa.Table:
        ids, x = t.column("vec_id").to_numpy(), _unit(t.column("embedding").combine_chunks()).astype(np.float32)
        many, step, others, similarity = min(degree, len(ids) - 1), max(1, CELLS // len(ids)), [], []
        for i in range(0, len(ids), step):
            s = x[i : i + step] @ x.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
            cols = _nearest(s, many)
            others.append(ids[cols].ravel())
            similarity.append(np.round(np.take_along_axis(s, cols, 1).ravel().astype(np.float64), DECIMALS))
        lists = _lists(np.repeat(np.arange(len(ids)), many), len(ids), np.concatenate(others), np.concatenate(similarity))
        return pa.table({"node": ids, "others": lists[0], "similarities": lists[1]})

    return _merged(dealt.groupBy("part").applyInArrow(near, _LIST).withColumn("new", F.lit(False)), degree, total)


def _had(lists: DataFrame, nodes: DataFrame, degree: int) -> float:
    """The share of their true neighbours that a sample of vectors has, others as similar being as good."""
    some = checkpointed(nodes.orderBy(F.xxhash64("vec_id", F.lit(19)), "vec_id").limit(SAMPLE).withColumnRenamed("vec_id", "query_id"))
    has = _edges(lists.join(F.broadcast(some.select(F.col("query_id").alias("node"))), "node", "left_semi")).select(F.col("node").alias("query_id"), "similarity", F.lit(1).alias("rank"))
    return recall_with_ties(has, knn(some, nodes, degree, exclude_self=True), degree).agg(F.avg("recall")).first()[0] or 0.0


def _members(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """The rows of ``nodes`` with ``at``: each vector with its neighbours and the nearest of those that name it."""
    back = _best_of(edges.select(F.col("other").alias("node"), F.col("node").alias("other"), "similarity"), degree)
    known = edges.select("node", "other").union(back.select("node", "other")).distinct()
    both = known.union(nodes.select("vec_id", "vec_id")).toDF("at", "vec_id")
    return both.join(nodes, "vec_id")


class Graph(NamedTuple):
    layers: list[DataFrame]  # vec_id, embedding, neighbours (ids) vectors (theirs, of length 1) and bucket; all vectors first
    doors: DataFrame  # vec_id and embedding of where searches begin


def build(store: DataFrame, degree: int = DEGREE, cell: int = CELL, rounds: int = ROUNDS, entries: int = ENTRIES) -> Graph:
    """The graph of all vectors of ``store`` (vec_id, embedding) of the commonest length, and those above it."""
    rows = store.where(F.size("embedding") > 0).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.size("embedding").alias("dim"))
    common = rows.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    place = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 40))
    nodes = checkpointed(rows.where(F.col("dim") == (common["dim"] if common else -1)).select("vec_id", "embedding", place.alias("place")))
    total, layers, share = nodes.count(), [], 1
    while not layers or total // share > entries:
        layers.append(_layer(nodes.where(F.col("place") < (1 << 40) // share).drop("place"), degree, cell, rounds))
        share *= SHRINK
    return Graph(layers, checkpointed(nodes.orderBy("place", "vec_id").limit(entries).drop("place")))


def _layer(nodes: DataFrame, degree: int, cell: int, rounds: int) -> DataFrame:
    """Every vector of ``nodes`` with its neighbours among them."""
    total = nodes.count()
    buckets = max(1, -(-total // BUCKET))
    lists = checkpointed(_first(nodes, total, degree, cell))

    def introduce(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, x = t.column("vec_id").to_numpy(), _unit(t.column("embedding").combine_chunks()).astype(np.float32)
        s = np.round((x @ x.T).astype(np.float64), DECIMALS)
        np.fill_diagonal(s, -2)
        s[s <= t.column("bar").to_numpy()[:, None]] = -2  # only what is better than what it has
        if many := min(degree, len(ids) - 1):
            cols = np.sort(_nearest(s, many), axis=1)
            rows, at = np.nonzero(np.take_along_axis(s, cols, 1) > -2)
            met, of = np.unique(rows, return_inverse=True)
            if len(met):
                cols = cols[rows, at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[met]), *_lists(of, len(met), ids[cols], s[rows, cols])], names=["node", "others", "similarities"])

    while total > cell and rounds and _had(lists, nodes, degree) < LISTS:
        rounds -= 1
        bar = F.when(F.size("others") >= degree, F.array_min("similarities")).otherwise(F.lit(-2.0))
        barred = nodes.join(lists.select(F.col("node").alias("vec_id"), bar.alias("bar")), "vec_id")
        met = _grouped(_members(_edges(lists), barred, degree), "at", introduce, _LIST)
        both = lists.drop("fresh").withColumn("new", F.lit(False)).unionByName(met.withColumn("new", F.lit(True)))
        lists = checkpointed(_merged(both, degree, total))
        changed, held = lists.agg(F.sum("fresh"), F.sum(F.size("others"))).first()
        if changed <= STILL * held:
            break

    def thin(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, at = t.column("vec_id").to_numpy(), t.column("at")[0].as_py()
        column = t.column("embedding").combine_chunks()
        x = _unit(column)
        own = int(np.flatnonzero(ids == at)[0])
        s = x @ x.T
        order = [k for k in np.lexsort((ids, -s[own])).tolist() if k != own]
        kept, spare, reached = [], [], np.zeros(len(ids), dtype=bool)
        for k in order:
            if len(kept) == degree:
                break
            (spare if reached[k] else kept).append(k)
            if not reached[k]:
                reached |= s[k] > s[own]
        kept = (kept + spare)[:degree]
        vectors = _lists(np.repeat(np.arange(len(kept)), x.shape[1]), len(kept), x[kept].astype(np.float32).ravel())[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([at]), column.slice(own, 1), pa.array([ids[kept].tolist()], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), vectors), pa.array(_bucket(ids[own : own + 1], buckets))],
            names=["vec_id", "embedding", "neighbours", "vectors", "bucket"],
        )

    schema = "vec_id long, embedding array<float>, neighbours array<long>, vectors array<array<float>>, bucket int"
    thinned = _grouped(_members(_edges(lists), nodes, degree), "at", thin, schema)
    return checkpointed(thinned.repartition(buckets, "bucket"))  # as the rounds of a search read it


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


_BEAM = "query_id long, embedding array<float>, vec_ids array<long>, similarities array<double>, open array<boolean>, bar double, buckets array<int>, targets array<array<long>>"


def _beams(queries: pa.Table, row: np.ndarray, ids: np.ndarray, similarity: np.ndarray, open_: np.ndarray, beam: int, width: int, buckets: int) -> pa.Table:
    """The beam of every query, and of what it asks now: the best that are open in it, by buckets; ``bar`` is the similarity from which on others may enter."""
    n = len(queries)
    row, ids, similarity, open_ = _ranked(row, ids, similarity, open_, beam)
    bar, last = np.full(n, -2.0), np.searchsorted(row, np.arange(n), "right") - 1
    full = np.bincount(row, minlength=n) >= beam
    bar[full] = similarity[last[full]]
    waiting = np.flatnonzero(open_)
    now = waiting[np.arange(len(waiting)) - np.searchsorted(row[waiting], row[waiting]) < width]
    open_[now] = False
    of, to = row[now], _bucket(ids[now], buckets)
    order = np.lexsort((to, of))
    of, to, asked = of[order], to[order], ids[now][order]
    border = np.ones(len(of), dtype=bool)
    border[1:] = (of[1:] != of[:-1]) | (to[1:] != to[:-1])
    starts = np.flatnonzero(border)
    each = pa.ListArray.from_arrays(pa.array(np.append(starts, len(of)), pa.int32()), pa.array(asked))
    held = _lists(row, n, ids, similarity, open_)
    at = pa.array(np.searchsorted(of[starts], np.arange(n + 1)), pa.int32())
    columns = [queries.column("query_id"), queries.column("embedding"), *held, pa.array(bar), pa.ListArray.from_arrays(at, pa.array(to[starts])), pa.ListArray.from_arrays(at, each)]
    return pa.table(columns, names=["query_id", "embedding", "vec_ids", "similarities", "open", "bar", "buckets", "targets"])


def search(queries: DataFrame, graph: Graph, k: int = 3, *, beam: int = BEAM, width: int = WIDTH, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, similarity and rank of about the k nearest vectors of ``graph`` for each row of ``queries`` (query_id, embedding)."""
    spark = queries.sparkSession
    drawn = graph.doors.toArrow()  # of a bounded number
    doors = spark.sparkContext.broadcast((drawn.column("vec_id").to_numpy(), _unit(drawn.column("embedding").combine_chunks()) if len(drawn) else np.zeros((0, 0))))
    dims = doors.value[1].shape[1]
    asked = queries.where(F.size("embedding") == dims).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    found = "query_id long, vec_ids array<long>, similarities array<double>"
    mine = ["query_id", "embedding", "vec_ids", "similarities", "open"]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = doors.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            s = np.round((y := _unit(b.column(1))) @ x.T, DECIMALS)
            best = _nearest(s, min(width, len(ids)))
            at = np.repeat(np.arange(b.num_rows), best.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), *_lists(np.repeat(np.arange(b.num_rows), dims), b.num_rows, y.astype(np.float32).ravel()), *_lists(at, b.num_rows, ids[best.ravel()], s[at, best.ravel()])], names=["query_id", "embedding", "vec_ids", "similarities"])

    def answer(q: pa.Table, n: pa.Table) -> pa.Table:
        n = n.sort_by("vec_id")
        ids, bar = n.column("vec_id").to_numpy(), q.column("bar").to_numpy()
        y, x = (c.combine_chunks().flatten(recursive=True).to_numpy().reshape(-1, dims) for c in (q.column("embedding"), n.column("vectors")))
        own, to = _flat(q.column("targets"))
        to = np.searchsorted(ids, to)
        order = np.argsort(to, kind="stable")
        own, to = own[order], to[order]
        of, others = _flat(n.column("neighbours"))
        starts = np.searchsorted(of, np.arange(len(ids) + 1))
        met = [(own[:0], others[:0], np.empty(0, dtype=np.float32))]
        for v in np.unique(to).tolist():
            i, j = np.searchsorted(to, (v, v + 1)).tolist()
            here = slice(starts[v], starts[v + 1])
            for m in range(i, j, ASKED):  # queries that ask for the neighbours of one vector are one product
                at = own[m : min(j, m + ASKED)]
                s = y[at] @ x[here].T
                rows, cols = np.nonzero(s >= bar[at, None] - 10.0**-DECIMALS)
                met.append((at[rows], others[here][cols], s[rows, cols]))
        row, other, similarity = map(np.concatenate, zip(*met))
        order = np.argsort(row, kind="stable")
        row, other, similarity = row[order], other[order], np.round(similarity[order].astype(np.float64), DECIMALS)
        some, of = np.unique(row, return_inverse=True)
        lists = _lists(of, len(some), other, similarity)
        return pa.table({"query_id": q.column("query_id").to_numpy()[some], "vec_ids": lists[0], "similarities": lists[1]})

    def steps(most: int, many: int, buckets: int) -> tuple[Callable, Callable]:
        def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = pa.Table.from_batches([b])
                row, ids = _flat(t.column("vec_ids"))
                yield from _beams(t, row, ids, _flat(t.column("similarities"))[1], np.ones(len(row), dtype=bool), most, many, buckets).combine_chunks().to_batches()

        def merge(t: pa.Table) -> pa.Table:
            q, f = t.filter(pc.is_valid(t.column("embedding"))), t.filter(pc.is_null(t.column("embedding")))
            own = q.column("query_id").to_numpy()
            order = np.argsort(own)
            (row, ids), (at, others) = _flat(q.column("vec_ids")), _flat(f.column("vec_ids"))
            at = order[np.searchsorted(own[order], f.column("query_id").to_numpy())][at]
            similarity = np.concatenate([_flat(t.column("similarities"))[1] for t in (q, f)])
            open_ = np.concatenate([_flat(q.column("open"))[1].astype(bool), np.ones(len(at), dtype=bool)])
            return _beams(q, np.concatenate([row, at]), np.concatenate([ids, others]), similarity, open_, most, many, buckets)

        return begin, merge

    state = checkpointed(asked.mapInArrow(enter, "query_id long, embedding array<float>, vec_ids array<long>, similarities array<double>"))
    total = state.count()
    for layer in reversed(graph.layers):
        most, many = (beam, width) if layer is graph.layers[0] else (min(width, WIDTH),) * 2
        buckets = max(1, -(-layer.count() // BUCKET))
        blocks = max(1, -(-total * 4 * most // HELD))
        begin, merge = steps(most, many, buckets)

        links = layer.select("vec_id", "neighbours", "vectors", F.col("bucket").alias("slot"))
        dealt = {1: links}
        block = F.pmod(F.xxhash64("query_id", F.lit(23)), F.lit(blocks)).alias("block")
        state, settled = checkpointed(state.mapInArrow(begin, _BEAM)), []
        while load := state.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().agg(F.max("count")).first()[0]:
            parts = -(-load // REQUESTS)
            if parts not in dealt:
                each = links.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
                dealt[parts] = checkpointed(each.select((F.col("slot") * parts + F.col("part")).alias("slot"), "vec_id", "neighbours", "vectors").repartition(buckets * parts, "slot"))
            settled.append(state.where("size(buckets) = 0"))
            still = state.where("size(buckets) > 0")
            slot = F.col("ask.buckets") * parts + F.pmod(F.xxhash64("query_id", F.lit(13)), F.lit(parts)).cast("int")
            ahead = still.select("query_id", "embedding", "bar", F.explode(F.arrays_zip("buckets", "targets")).alias("ask")).select(slot.alias("slot"), "query_id", "embedding", "bar", F.col("ask.targets").alias("targets"))
            answers = ahead.groupBy("slot").cogroup(dealt[parts].groupBy("slot")).applyInArrow(answer, found)
            # a union: sizes that Spark estimates of co-groups multiply, and beams from beams would square them in each round
            both = still.select(*mine).unionByName(answers, allowMissingColumns=True).withColumn("block", block)
            state = checkpointed(both.groupBy("block").applyInArrow(merge, _BEAM))
        for s in settled:
            state = state.unionByName(s)
        state = state.select("query_id", "embedding", "vec_ids", "similarities").repartition("query_id")
    head = [F.slice(c, 1, k + 1).alias(name) for c, name in (("vec_ids", "vec_id"), ("similarities", "similarity"))]
    best = state.select("query_id", *head).select("query_id", F.explode(F.arrays_zip("vec_id", "similarity")).alias("e"))
    rows = best.select("query_id", F.col("e.vec_id").alias("vec_id"), F.col("e.similarity").alias("similarity"))
    return top_k(rows.where("query_id != vec_id") if exclude_self else rows, ["query_id"], [F.desc("similarity"), F.col("vec_id")], k)


def tune(queries: DataFrame, store: DataFrame, graph: Graph, k: int, wanted: float, *, first: float = 0.0, sample: int = 2_000) -> int:
    """The least beam, doubled from :data:`BEAM` on, with which a sample of ``queries`` finds the share ``wanted`` of the true k
    nearest of ``store``, and of ``first`` queries the nearest; both by three standard errors.

    A fixed beam finds ever less of a growing store.  One that holds all vectors is where it ends.
    """
    asked = checkpointed(queries.where("embedding is not null").orderBy(F.xxhash64("query_id", F.lit(7)), "query_id").limit(sample))
    truth = checkpointed(knn(asked, store, k))
    total, beam = graph.layers[0].count(), BEAM
    sure = lambda c: F.avg(c) - 3 * F.coalesce(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count(c))
    while beam < total:
        got = recall_with_ties(search(asked, graph, k, beam=beam, width=beam // 4), truth, k)
        least = got.agg(sure(F.col("recall")), sure(F.col("first").cast("double"))).first()
        if least[0] is None or (least[0] >= wanted and least[1] >= first):
            break
        beam *= 2
    return beam
