"""Exact top-k search by inner product with an M-tree and best-first search.

An inner product is turned into a metric: with M the largest norm of all vectors and one more component
``sqrt(M^2 - |x|^2)`` on each of them (0 on a query), the squared Euclidean distance is ``|q|^2 + M^2 - 2 q.x``, so the
nearest vectors are those of the highest products.

The upper level of the tree is a table: every vector goes to the nearest of some routing vectors, of which there are at
most ``PIVOTS``; a routing vector with more than ``BLOCK`` vectors, or ``BYTES`` of them, has several blocks.  Of each block the tree is built once
and stored, with its covering radius.  Below, an M-tree of paged nodes holds for every entry a routing vector, its covering
radius and its distance to the parent.

A query first searches the block it is nearest to, which gives a k-th best product to beat, and is then sent to those
other blocks only whose routing vector and radius allow for one as good.  In a block, a search expands nodes in the order
of the best product they could hold and skips entries whose stored distances rule them out by the triangle inequality,
before any distance to them is computed.  Queries reach a block's tree as a sorted stream, at most ``QUERY_BLOCK`` of them
in a task.  Bounds are floating point with a margin; products themselves are exact integers.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do those without an
id; vectors meet only those of their own length; a query is a row, and all rows but itself are its candidates, repeated
ids included; components of up to 1.75e305 count, by integers of any length where they are too large for exact products
otherwise; a larger finite component is an error, as is a returned score that no long holds; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echolake.llm.base import discard, materialize, sampled, slices, tidy

PAGE = 256
BLOCK, BYTES = 16_384, 16 << 20  # most vectors of a block, and bytes of their numbers
SENT = 8 << 20  # bytes of queries that a routing task sends on at once
PIVOTS = 2_048  # most routing vectors of a length, which are broadcast
QUERY_BLOCK = 65_536
LEAST_BLOCKS = 12
MODULUS = 100
_LONG = 1 << 63
_LARGE = 1e140  # squares of larger components could not be added up
_FINITE = 1.7976931348623157e308 / 1024  # 1024 times more is no double


class Node:
    """A page: for a leaf the row numbers of its entries, for an inner node its children; arrays run over the entries."""

    __slots__ = ("children", "parent_distance", "pivots", "radius", "rows")

    def __init__(self, pivots, radius, parent_distance, children=None, rows=None):
        self.pivots, self.radius, self.parent_distance, self.children, self.rows = pivots, radius, parent_distance, children, rows


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x - p) ** 2).sum(1), 0))


def build(x: np.ndarray, rows: np.ndarray, parent: np.ndarray, rng: np.random.Generator, page: int = PAGE) -> Node:
    """The tree over ``x[rows]``, whose parent routing vector is ``parent``."""
    if len(rows) <= page:
        return Node(x[rows], np.zeros(len(rows)), _distances(x[rows], parent), rows=rows)
    k = min(page, max(2, -(-2 * len(rows) // page)))
    pivots = x[rng.choice(rows, k, replace=False)]
    d2 = (x[rows] ** 2).sum(1)[:, None] - 2 * x[rows] @ pivots.T + (pivots**2).sum(1)[None]
    nearest = d2.argmin(1)
    if np.bincount(nearest, minlength=k).max() == len(rows):  # copies of one vector: any split is as good
        nearest = np.arange(len(rows)) % k
    parts = [(j, rows[nearest == j]) for j in range(k) if (nearest == j).any()]
    at = np.array([pivots[j] for j, _ in parts])
    radius = np.array([_distances(x[r], pivots[j]).max() for j, r in parts])
    return Node(at, radius, _distances(at, parent), children=[build(x, r, pivots[j], rng, page) for j, r in parts])


class MTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, top: float | None = None, centre: np.ndarray | None = None, page: int = PAGE):
        """``vectors``: integers, as float64; ``ids``: of the rows; ``rows``: numbers that tell rows of one id apart; ``top``: the
        largest squared norm there is; ``centre``: the routing vector."""
        self.vectors, self.ids, self.rows = vectors, ids, ids if rows is None else rows
        self.most = float(np.abs(vectors).max())
        self.computed = 0  # distances computed so far, for tests of pruning
        norms = (vectors**2).sum(1)
        self.top = float(norms.max()) if top is None else top
        augmented = augment(vectors, self.top)
        self.centre = augmented.mean(0) if centre is None else centre
        self.radius = float(_distances(augmented, self.centre).max())
        self.root = build(augmented, np.arange(len(ids)), self.centre, np.random.default_rng(5), page)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact products: in float64 below 2^53, in integers of 64 bits or of any length above."""
        reach = self.most * float(np.abs(q).max()) * len(q)
        kind = np.float64 if reach < 2**53 else np.int64 if reach < 2**62 and max(self.most, float(np.abs(q).max())) < 2**62 else object
        if kind is object:
            whole = [int(x) for x in q.tolist()]
            return np.array([sum(int(a) * b for a, b in zip(v, whole)) for v in self.vectors[rows].tolist()], dtype=object)
        return self.vectors[rows].astype(kind) @ q.astype(kind)

    def search(self, q: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) of at least ``least``, ties to the smaller id; the row of number ``own`` does not count."""
        qq = float(q @ q)
        a = np.append(q, 0.0)
        half = (qq + self.top) / 2
        margin = 1e-9 * (half + 1) + 1e-6
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        floor = -np.inf if least is None else least  # no lower score is of use
        order = count()
        todo = [(-np.inf, next(order), self.root, float(np.sqrt(((a - self.centre) ** 2).sum())))]
        while todo:
            bound, _, node, to_parent = heapq.heappop(todo)
            if -bound + margin < floor:
                break
            # what can be at most there, by the distances to the parent alone
            entries = np.arange(len(node.parent_distance))
            if floor > -np.inf:
                apart = np.maximum(np.abs(to_parent - node.parent_distance) - node.radius, 0)
                entries = np.flatnonzero(half - apart * apart / 2 + margin >= floor)
                if not len(entries):
                    continue
            self.computed += len(entries)
            if node.children is None:
                rows = node.rows[entries]
                scores = self.scores(rows, q)
                if floor > -np.inf:
                    good = np.flatnonzero(scores >= floor)
                    rows, scores = rows[good], scores[good]
                keep = np.lexsort((self.ids[rows], -scores))
                for s, i, row in zip(scores[keep].tolist(), self.ids[rows[keep]].tolist(), self.rows[rows[keep]].tolist()):
                    if row == own:
                        continue
                    entry = (int(s), -i)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    elif s < best[0][0]:
                        break
                if len(best) == k:
                    floor = max(floor, best[0][0])
                continue
            distance = np.sqrt(np.maximum(((node.pivots[entries] - a) ** 2).sum(1), 0))
            apart = np.maximum(distance - node.radius[entries], 0)
            most = half - apart * apart / 2
            for e, d, m in zip(entries.tolist(), distance.tolist(), most.tolist()):
                if m + margin >= floor:
                    heapq.heappush(todo, (-m, next(order), node.children[e], d))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


class Scan:
    """In place of a tree where squares of components overflow: compares all."""

    radius = np.inf

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.vectors, self.ids, self.rows = [[int(x) for x in v] for v in vectors.tolist()], ids.tolist(), rows.tolist()

    def search(self, q: np.ndarray, own: int, k: int, least: int | None = None) -> list[tuple[int, int]]:
        whole = [int(x) for x in q.tolist()]
        scored = ((sum(a * b for a, b in zip(v, whole)), i) for v, i, row in zip(self.vectors, self.ids, self.rows) if row != own)
        return heapq.nsmallest(k, ((s, i) for s, i in scored if least is None or s >= least), key=lambda x: (-x[0], x[1]))


def augment(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))[:, None]])


def _vectors(df: DataFrame) -> DataFrame:
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    beyond = F.raise_error(F.lit("a component times 1024 exceeds a double")).cast("double")
    scaled = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) <= _FINITE, F.lit(1024.0) * x.cast("double")).otherwise(beyond))
    # a component of 2^53 and more is whole; floor() would make it a long
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim")).where("dim > 0")
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).withColumn("large", F.exists("v", lambda x: F.abs(x) > _LARGE))


def _rows(dim: int, block: int) -> int:
    """How many vectors of ``dim`` numbers a block holds at most."""
    return max(1, min(block, BYTES // (8 * dim)))


class Routes:
    """Of one length: the largest squared norm, the routing vectors, and how many blocks each has."""

    def __init__(self, top: float, pivots: np.ndarray):
        self.top, self.pivots = top, augment(pivots, top)
        self.squares = (self.pivots**2).sum(1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of augmented vectors to all routing vectors; approximate to a part in 10^7 of the largest norm."""
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + self.squares[None], 0))


_FOUND = "row long, query_id long, vec_id long, score long"
_FOUND_TYPES = [pa.int64()] * 4


def _routes(rows: DataFrame, blocks: dict[int, int]) -> dict[int, Routes]:
    """At most PIVOTS rows of each length come to the driver, those of the smallest hashes, and a sum a length."""
    tops = {r["dim"]: r["top"] for r in rows.where("not large").groupBy("dim").agg(F.max("norm").alias("top")).collect()}
    found = {}
    for dim, top in tops.items():
        own = rows.where((F.col("dim") == dim) & ~F.col("large"))
        some = sampled(own, min(PIVOTS, blocks[dim]), F.xxhash64("v"), F.col("row")).select("v").collect()
        found[dim] = Routes(top, np.array([r["v"] for r in some]))
    return found


def top_k(embeddings: DataFrame, k: int = 10, modulus: int = MODULUS, block: int = BLOCK, query_block: int = QUERY_BLOCK, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of every row whose id ``modulus`` divides."""
    spark = embeddings.sparkSession
    rows = materialize(_vectors(embeddings), "mtree-rows")  # stored, so that row numbers stay
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    blocks = {dim: max(least_blocks, -(-n // _rows(dim, block))) for dim, n in sizes.items()}
    routes = spark.sparkContext.broadcast(_routes(rows, blocks))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            dims, place = b.column(3).to_numpy(), np.full(b.num_rows, -1, dtype=np.int64)
            regular = ~np.array(b.column(5).to_pylist(), dtype=bool)
            for dim in np.unique(dims[regular]).tolist():
                at = np.flatnonzero(regular & (dims == dim))
                r = routes.value[dim]
                place[at] = r.distances(augment(np.array(b.column(2).take(pa.array(at)).to_pylist()), r.top)).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(place)], names=["row", "vec_id", "v", "dim", "pivot"])

    placed = materialize(rows.mapInArrow(tidy(nearest), "row long, vec_id long, v array<double>, dim int, pivot long"), "mtree-placed")
    counts = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"))
    held = F.greatest(F.lit(1), F.least(F.lit(block), F.lit(BYTES) / (8 * F.col("dim"))).cast("long"))
    parts = counts.select("dim", "pivot", F.ceil(F.col("n") / held).alias("parts"))  # one row a routing vector at most
    own = placed.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))

    def plant(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, pivot, part = (int(pdf[c].iloc[0]) for c in ("dim", "pivot", "part"))
        x, ids, numbers = np.stack(pdf["v"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy(), pdf["row"].to_numpy()
        tree = Scan(x, ids, numbers) if pivot < 0 else MTree(x, ids, numbers, routes.value[dim].top, routes.value[dim].pivots[pivot])
        return pd.DataFrame({"dim": [dim], "pivot": [pivot], "part": [part], "n": [len(ids)], "radius": [float(tree.radius)], "tree": [pickle.dumps(tree)]})

    trees = own.groupBy("dim", "pivot", "part").applyInPandas(plant, "dim int, pivot long, part long, n long, radius double, tree binary")
    trees = materialize(trees.withColumn("block", F.monotonically_increasing_id()), "mtree-blocks")
    # a number of blocks that is bounded by PIVOTS or by the rows over BLOCK: a few numbers of each are what routes queries
    known: dict[int, tuple] = {}
    for r in trees.select("dim", "pivot", "radius", "block").orderBy("dim", "block").collect():
        known.setdefault(r["dim"], ([], [], []))
        for held, value in zip(known[r["dim"]], (r["block"], r["pivot"], r["radius"])):
            held.append(value)
    areas = spark.sparkContext.broadcast({d: tuple(np.array(c) for c in cs) for d, cs in known.items()})
    queries = rows.where(F.col("vec_id") % modulus == 0).select("row", "vec_id", "v", "dim", "large")

    def routed(first: bool):
        def packed(out: list[tuple]) -> pa.RecordBatch:
            part = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64()])], names=["block", "row", "vec_id", "v", "low"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                out, size = [], 0
                lows = b.column(5).to_pylist()
                for row, vec_id, v, dim, large, low in zip(*[c.to_pylist() for c in b.columns[:5]], lows):
                    ids, pivots, radius = areas.value[dim]
                    if large or not (regular := pivots >= 0).any():
                        order, most = np.arange(len(ids)), np.full(len(ids), np.inf)
                    else:
                        r, q = routes.value[dim], np.array(v)
                        half = (float(q @ q) + r.top) / 2
                        apart = r.distances(np.append(q, 0.0)[None])[0][np.maximum(pivots, 0)] - radius - 1e-6 * np.sqrt(2 * half)
                        most = np.where(regular, half - np.maximum(apart, 0) ** 2 / 2 + 1e-9 * (half + 1) + 1e-6, np.inf)
                        order = np.argsort(apart, kind="stable")
                    chosen = order[:1] if first else [i for i in order[1:].tolist() if low is None or most[i] >= low]
                    for i in chosen:  # a query that reaches many blocks leaves in pieces
                        out.append((int(ids[i]), row, vec_id, v, low))
                        size += 8 * dim + 32
                        if size >= SENT:
                            yield packed(out)
                            out, size = [], 0
                yield packed(out)

        return run

    def searched(wanted: DataFrame, label: str) -> DataFrame:
        wanted = materialize(wanted, f"mtree-{label}-queries")
        many = wanted.groupBy("block").agg(F.ceil(F.count("*") / query_block).alias("parts"))
        sent = wanted.join(F.broadcast(many), "block").select("block", F.pmod(F.xxhash64("row"), F.col("parts")).alias("q"), F.lit(None).cast("binary").alias("tree"), "row", "vec_id", "v", "low")
        copies = trees.join(F.broadcast(many), "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("q"), "tree", *[F.lit(None).cast(t).alias(c) for c, t in (("row", "long"), ("vec_id", "long"), ("v", "array<double>"), ("low", "long"))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = None
            for b in slices(batches):
                out = []
                for i, (row, vec_id, v, low) in enumerate(zip(*[b.column(j).to_pylist() for j in (3, 4, 5, 6)])):
                    if row is None:  # the tree sorts before its queries
                        tree = pickle.loads(b.column(2)[i].as_py())
                        continue
                    out += [(row, vec_id, i, min(max(s, -_LONG), _LONG - 1)) for s, i in tree.search(np.array(v), row, k, low)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, _FOUND_TYPES)], names=[x.split()[0] for x in _FOUND.split(", ")])

        dealt = copies.unionByName(sent).repartition("block", "q").sortWithinPartitions("block", "q", F.col("row").asc_nulls_first())
        got = materialize(dealt.mapInArrow(tidy(run), _FOUND), f"mtree-{label}")
        discard(wanted)
        return got

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    near = searched(queries.withColumn("low", F.lit(None).cast("long")).mapInArrow(tidy(routed(True)), "block long, row long, vec_id long, v array<double>, low long"), "near")
    lows = near.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("low"))
    rest = queries.join(lows, "row", "left").select("row", "vec_id", "v", "dim", "large", "low")
    far = searched(rest.mapInArrow(tidy(routed(False)), "block long, row long, vec_id long, v array<double>, low long"), "far")
    discard(rows, placed, trees)
    ranked = near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    fits = (F.col("score") > -_LONG) & (F.col("score") < _LONG - 1)  # the ends stand for what lies beyond
    score = F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("a score of the best exceeds a long")).cast("long"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))
