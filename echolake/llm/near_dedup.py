"""Near-duplicate detection with an LSH forest of MinHash signatures.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z; a document's set is its distinct shingles of ``SHINGLE`` words, or
the whole sequence where it has fewer.  Documents with the same set form a class, and classes are what is compared.

Candidates.  A signature of ``HASHES`` min-hashes is read in ``TREES`` orders.  Each order is sorted as a whole, by range
partitions that need no key's rows together.  Rows that share the first ``LEAST_DEPTH`` values form a region.  A small
region gives all its pairs; a larger one is split by the next value, as often as needed, so that the depth adapts to
how crowded the region is; and neighbours in the sorted order, whose common prefix is the longest there is, are
always candidates.  A region of n rows thus gives O(n) candidates and no row is left without one.

Crowded regions.  What lies in a region of more than SMALL rows is compared until nothing is open: wherever such a region
still has rows of several components, first all of its rows meet the one with the most links, so that a text with many
copies that are not alike among themselves costs a comparison a copy.  The rows of regions that are still open then meet
in an exact join by prefix filter: shingles are ordered by how rare they are among these rows, and two sets can only be
similar enough if the rare ends of both share a shingle at places that leave enough behind.  Of templated pages, which
share most shingles and are yet not alike, these ends hold what is a page's own, so they hardly meet.  That join is an
equi-join on shingles with sizes and places as conditions; it needs no region's rows together and drops no pair.

Links.  Candidates are confirmed on the full sets of words.  Those of the first ``EARLY`` orders are confirmed first and
their components found; of the others only candidates between different components remain, so a large group of near
copies costs a few comparisons a row.  Components are found by label propagation with pointer jumping over stored
tables; no links or labels come to the driver.

What can be missed: a pair that shares no region of depth ``LEAST_DEPTH`` in any of the orders.  For two documents of
similarity 0.8 the chance is (1 - 0.8^3)^20, under 1e-6.  Two that share a region always end in one component if they are
alike: a small region compares all its pairs, a crowded one is compared until it is one component or the exact join has
found all pairs of its rows.

Defined cases: documents without words have an empty set, link with nothing and are their own component; so are those
without an id, whose component is null and which are kept; rows that share an id are one node, whose texts' components are
one; texts of any length are read whole; an empty table gives no rows; extra columns are ignored by :func:`components_of`
and kept by :func:`deduplicate`, which keeps one row of a repeated id, that of the smallest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, materialize, maybe_in, slices, tidy

SHINGLE = 4
THRESHOLD = 80  # per cent
HASHES = 64
TREES = 20
LEAST_DEPTH = 3
DEPTH = 8
SMALL = 4
EARLY = 4
CELLS = 1 << 20  # of the shingle counts that order the exact join

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64)
_P, _M, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
# the first LEAST_DEPTH positions of different orders have nothing in common
_ORDERS = [[*range(LEAST_DEPTH * t, LEAST_DEPTH * (t + 1)), *[int(x) for x in _RNG.permutation([p for p in range(HASHES) if p // LEAST_DEPTH != t])[: DEPTH - LEAST_DEPTH]]] for t in range(TREES)]
_CHUNK = 100_000


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every word: the sum of its bytes' values times powers of a constant, mixed."""
    raw = np.frombuffer(text.encode().translate(_LOWER), dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), _CHUNK):
        s, e = starts[i : i + _CHUNK], ends[i : i + _CHUNK]
        lengths = e - s
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), _P))
        values = _BYTE[raw[place + np.repeat(s, lengths)]] * powers[place]
        out[i : i + _CHUNK] = np.add.reduceat(values, first)
    return _mixed(out)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    w = word_hashes(text) if text else np.empty(0, dtype=np.uint64)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.full(len(w) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = h * _P + w[j : len(w) - k + 1 + j]
    return np.unique(_mixed(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES min-hashes, each cut to 16 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _A + _B).min(0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(">u2")


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the fingerprint of the whole set (null if it is empty) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, prints, signs = [], [], []
            for text in b.column(1):
                s = shingle_hashes(text.as_py(), size)
                n.append(len(s))
                prints.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "print", "sign"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, print binary, sign binary")


def _orders(classes: DataFrame) -> DataFrame:
    """A row per class and order: the values in that order as big-endian bytes, so that bytes sort as values do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            signs = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=">u2").reshape(-1, HASHES)
            for t, order in enumerate(_ORDERS):
                keys = np.ascontiguousarray(signs[:, order])
                held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * DEPTH), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, dtype=np.int32)), held, b.column(0)], names=["tree", "key", "rep"])

    return classes.select("rep", "sign").mapInArrow(tidy(run), "tree int, key binary, rep long")


def region_pairs(keys: list[bytes], lo: int, hi: int, depth: int) -> Iterator[tuple[int, int]]:
    """Candidates among the sorted ``keys[lo:hi]``, which agree in the first ``depth`` values."""
    todo = [(lo, hi, depth)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo <= SMALL:
            yield from ((i, j) for i in range(lo, hi) for j in range(i + 1, hi))
        elif depth == DEPTH:
            yield from zip(range(lo, hi - 1), range(lo + 1, hi))
        else:
            a, b = 2 * depth, 2 * depth + 2
            start = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or keys[i][a:b] != keys[start][a:b]:
                    todo.append((start, i, depth + 1))
                    if i < hi:
                        yield i - 1, i
                    start = i


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of class representatives and the first order in which they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys, reps = np.empty(0, dtype=np.int32), np.empty((0, 2 * DEPTH), dtype=np.uint8), np.empty(0, dtype=np.int64)

        def found(until: int, runs: np.ndarray) -> pa.RecordBatch:
            out = []
            for lo, hi in zip(runs[:-1].tolist(), runs[1:].tolist()):
                if hi - lo > 1 and hi <= until:
                    held = [k.tobytes() for k in keys[lo:hi]]
                    t = int(tree[lo])
                    for i, j in region_pairs(held, 0, hi - lo, LEAST_DEPTH):
                        a, b = int(reps[lo + i]), int(reps[lo + j])
                        if a != b:
                            out.append((min(a, b), max(a, b), t))
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out) if out else [[]] * 3, [pa.int64(), pa.int64(), pa.int32()])], names=["a", "b", "tree"])

        for batch in batches:
            more = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, 2 * DEPTH)
            tree, keys, reps = np.concatenate([tree, batch.column(0).to_numpy()]), np.concatenate([keys, more]), np.concatenate([reps, batch.column(2).to_numpy()])
            if not len(tree):
                continue
            new = (tree[1:] != tree[:-1]) | (keys[1:, : 2 * LEAST_DEPTH] != keys[:-1, : 2 * LEAST_DEPTH]).any(1)
            runs = np.concatenate([[0], np.flatnonzero(new) + 1])  # the last region may go on
            yield found(int(runs[-1]), runs)
            tree, keys, reps = tree[runs[-1] :], keys[runs[-1] :], reps[runs[-1] :]
        if len(tree):
            yield found(len(tree), np.array([0, len(tree)]))

    ordered = _orders(classes).repartitionByRange("tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")
    return ordered.mapInArrow(tidy(run), "a long, b long, tree int").groupBy("a", "b").agg(F.min("tree").alias("tree"))


def crowded(classes: DataFrame) -> DataFrame:
    """``area`` (a region, by a hash of its order and values) and ``rep`` of all rows in regions of more than SMALL rows;
    rows of a few smaller ones may be among them."""
    rows = _orders(classes).select(F.xxhash64("tree", F.substring("key", 1, 2 * LEAST_DEPTH)).alias("area"), "rep")
    areas = materialize(rows.groupBy("area").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("area"), "near-areas")
    held = materialize(maybe_in(rows, "area", areas), "near-crowded")
    discard(areas)
    return held


def still_open(held: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of :func:`crowded` whose region has several components, with their component; of the region, its
    largest component ``main``, the rows ``m`` in it and the rows ``u`` outside."""
    at = held.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("area", "rep", F.coalesce("component", "rep").alias("component"))
    at = materialize(at, "near-placed")
    parts = at.groupBy("area", "component").agg(F.count("*").alias("n"))
    spread = parts.groupBy("area").agg(F.max(F.struct("n", "component")).alias("p"), F.sum("n").alias("n")).where("n > p.n")
    several = materialize(spread.select("area", F.col("p.component").alias("main"), F.col("p.n").alias("m"), (F.col("n") - F.col("p.n")).alias("u")), "near-several")
    rows = materialize(maybe_in(at, "area", several.select("area")).join(several, "area"), "near-open")
    discard(at, several)
    return rows


def pivot_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs (a < b) of an open region's row with the most links and each row of another component."""
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("degree"))
    ranked = rows.join(degree, "rep", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    # stored, so that the join has plain scans on both sides and splits a hot region's rows at run time
    pivots = materialize(ranked.groupBy("area").agg(F.max(F.struct("degree", "rep", "component")).alias("p")), "near-tops")
    pairs = rows.join(pivots, "area").where(F.col("component") != F.col("p.component"))
    return pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()


def needed(n: int | np.ndarray | Column, m: int | np.ndarray | Column, threshold: int):
    """Shingles that sets of ``n`` and ``m`` must share, times (100 + threshold)."""
    return threshold * (n + m)


def rare_ends(texts: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``shingle``, ``rep``, ``component``, ``n`` (of the set), ``place`` and ``least`` (the smaller set of a pair has it there) for
    the rarest shingles of every row of (rep, component, text): as many as a similar set must share one of.

    The order is by counts in CELLS hashed cells, which are broadcast, and then by hash.  Cells that several shingles share
    only make the order less apt; any order that is the same for all rows is right.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for b in slices(batches):
            for text in b.column(0):
                cells += np.bincount(shingle_hashes(text.as_py(), size) >> np.uint64(44), minlength=CELLS)
        at = np.flatnonzero(cells)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(cells[at[i : i + 50_000]])], names=["cell", "n"])

    found = texts.select("text").mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(CELLS, dtype=np.int64)
    cells[found.column(0).to_numpy()] = found.column(1).to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for rep, component, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                h = shingle_hashes(text.as_py(), size)
                n = len(h)
                if not n:
                    continue
                end = n - -(-threshold * n // 100) + 1
                least = n - -(-needed(n, n, threshold) // (100 + threshold)) + 1
                h = h[np.lexsort((h, held.value[h >> np.uint64(44)]))[:end]]
                k, place = len(h), np.arange(len(h))
                yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), *(pa.array(np.full(k, x, dtype=np.int64)) for x in (rep, component, n)), pa.array(place), pa.array(place < least)], names=["shingle", "rep", "component", "n", "place", "least"])

    return texts.select("rep", "component", "text").mapInArrow(tidy(run), "shingle long, rep long, component long, n long, place long, least boolean")


def prefix_pairs(rows: DataFrame, texts: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs (a < b) of rows of open regions, of different components, that include all whose sets are similar enough."""
    open_rows = rows.select("rep", "component").distinct()
    full = materialize(open_rows.join(texts.withColumnRenamed("id", "rep"), "rep").select("rep", "component", "text"), "near-full")
    ends = materialize(rare_ends(full, size, threshold), "near-ends")
    discard(full)
    # the smaller set (of equal ones that of the smaller id) has the shared shingle among its very rarest
    x, y = ends.where("least").drop("least").alias("x"), ends.drop("least").alias("y")
    enough = F.col("x.n") * 100 >= F.col("y.n") * threshold
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.rep") < F.col("y.rep")))
    behind = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) * (100 + threshold) >= needed(F.col("x.n"), F.col("y.n"), threshold)
    apart = F.col("x.component") != F.col("y.component")
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & apart & smaller & enough & behind)
    pairs = materialize(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct(), "near-met")
    discard(ends)
    return pairs


def shingle_set(text: str, size: int = SHINGLE) -> set:
    w = text.encode().translate(_LOWER).split()
    return set(zip(*(w[j:] for j in range(size)))) if len(w) >= size else {tuple(w)} if w else set()


def confirmed(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for b in slices(batches):
            out = []
            for a, z, ta, tz in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                if z != last:
                    last, held = z, shingle_set(tz.as_py(), size)
                other = shingle_set(ta.as_py(), size)
                both = len(other & held)
                if 100 * both >= threshold * (len(other) + len(held) - both) and both:
                    out.append((a, z))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 2)], names=["a", "b"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(tidy(run), "a long, b long")


def _contracted(links: DataFrame) -> DataFrame:
    """Links with the same components, at most one per node and task: each task's own links become stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def stars() -> pa.RecordBatch:
            got = [(x, r) for x in up if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*got) if got else [[]] * 2)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > 1_000_000:
                yield stars()
                up.clear()
        yield stars()

    return links.select("a", "b").mapInArrow(tidy(run), "a long, b long")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every node with a link."""
    few = materialize(_contracted(links), f"{label}-links")
    edges = materialize(few.union(few.select("b", "a")).toDF("id", "other").distinct(), f"{label}-edges")
    labels = materialize(edges.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component")), label)
    discard(few)
    while True:
        near = edges.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = materialize(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component")), label)
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("next"))
        # a component's smallest id is a node, so every label is found
        after = materialize(lower.join(jump, "component").select("id", "old", F.least("component", "next").alias("component")), label)
        discard(labels, lower)
        labels = after
        if after.where("component != old").isEmpty():
            discard(edges)
            return after


def _stars(labels: DataFrame) -> DataFrame:
    """Links with the components of ``labels``."""
    return labels.where("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _one_id(drawn: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of all texts that one id has; most tables have no such id."""
    several = drawn.where("doc_id is not null and print is not null").groupBy("doc_id").agg(F.min("print").alias("least"), F.max("print").alias("most")).where("least != most").select("doc_id")
    texts = drawn.where("print is not null").join(several, "doc_id").select("doc_id", "print").distinct()
    return texts.join(classes.select("print", "rep"), "print").where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def components_of(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = materialize(sketches(docs, size), "near-sketches")
    classes = materialize(drawn.where("print is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("sign").alias("sign")).where("rep is not null"), "near-classes")
    pairs = materialize(candidates(classes), "near-candidates")
    held = crowded(classes)
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(held.select("rep")).distinct(), "near-ids")
    # only texts that may be needed are shuffled to where the ids are
    wanted = maybe_in(docs.where("text is not null").withColumnRenamed("doc_id", "id"), "id", ids)
    texts = materialize(wanted.join(ids, "id"), "near-texts")
    early = materialize(confirmed(pairs.where(F.col("tree") < EARLY), texts, size, threshold), "near-links")
    first = components(early, "near-first")
    sides = [first.select(F.col("id").alias(s), F.col("component").alias(f"component_{s}")) for s in ("a", "b")]
    late = pairs.where(F.col("tree") >= EARLY).join(sides[0], "a", "left").join(sides[1], "b", "left")
    late = late.where(~F.coalesce("component_a", "a").eqNullSafe(F.coalesce("component_b", "b"))).select("a", "b")
    more = materialize(confirmed(late, texts, size, threshold), "near-links")
    last = components(_stars(first).union(more).union(_one_id(drawn, classes)), "near-last")
    for pairs_of in (lambda rows: materialize(pivot_pairs(rows, early.union(more)), "near-pivots"), lambda rows: prefix_pairs(rows, texts, size, threshold)):
        rows = still_open(held, last)
        if not rows.isEmpty():
            met = pairs_of(rows)
            found = materialize(confirmed(met, texts, size, threshold), "near-links")
            before, last = last, components(_stars(last).union(found), "near-last")
            discard(met, found, before)
        discard(rows)
    known = materialize(classes.select("print", "rep").join(last.select(F.col("id").alias("rep"), "component"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component")), "near-known")
    discard(classes, pairs, held, ids, texts, early, first, more, last)
    out = drawn.select("doc_id", "n_shingles", "print").join(known, "print", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull())), "near-components")
    discard(drawn, known)
    return out


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the smallest id.

    Rows that share an id but not their text are judged each: all but the smallest text of such an id come after all ids of
    the table, so that they go only where they are copies of something that stays.  Of equal rows one stays.
    """
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "near-again")
    if again.isEmpty():
        return _without(docs, _gone(docs, **options))
    # ids that occur once, which are nearly all, are not shuffled for the sake of the others
    once = maybe_in(docs, "doc_id", again, keep=False).union(maybe_in(docs, "doc_id", again).join(again, "doc_id", "left_anti").select(*docs.columns))
    several = maybe_in(docs, "doc_id", again).join(again, "doc_id", "left_semi").select(*docs.columns)
    top = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0)).alias("top")).first()[0]
    texts = several.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).distinct()
    least = texts.groupBy("id").agg(F.min("t").alias("least"))
    # those of one table are stored, since numbers are given as they are written
    nodes = materialize(texts.join(least, "id").select("id", "t", F.when(F.col("t") == F.col("least"), F.col("id")).otherwise(top + 1 + F.monotonically_increasing_id()).alias("node")), "near-nodes")
    judged = once.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).union(nodes.select(F.col("node").cast("long"), "t"))
    gone = _gone(judged, **options)
    kept = nodes.join(gone.withColumnRenamed("doc_id", "node"), "node", "left_anti")
    # a row for each text that stays, with all its columns
    place = F.struct("text", *[c for c, t in docs.dtypes if c != "text" and "map<" not in t and t != "variant"])
    first = several.groupBy(F.col("doc_id").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t")).agg(F.min_by(F.struct(*docs.columns), place).alias("row"))
    rest = first.join(kept, (F.col("_id") == F.col("id")) & (F.col("_t") == F.col("t")), "left_semi").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
    return _without(once, gone).union(rest)


def _gone(docs: DataFrame, **options) -> DataFrame:
    """The ids that go, stored."""
    judged = components_of(docs, **options)
    gone = materialize(judged.where(~F.col("kept")).select("doc_id").distinct(), "near-gone")
    discard(judged)
    return gone


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone``; most rows are surely not among them and need no shuffle."""
    doubtful = maybe_in(docs, "doc_id", gone).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return maybe_in(docs, "doc_id", gone, keep=False).union(doubtful)
