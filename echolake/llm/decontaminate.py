"""Benchmark decontamination: a broadcast hash set of normalised test n-grams is scanned against every document.

Words are the maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z.  A window is ``size``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window.  Texts are handled as
UTF-8 bytes, where every byte over 0x7F belongs to a word, so one ``bytes.translate`` and one ``split`` find the words
of a whole text.  Words that no item has become 0, and only runs without a 0 are hashed and looked up; a lookup that
hits is verified on the full word sequence.

The benchmark side is broadcast only in blocks whose built set takes at most ``MEMORY`` bytes by count of its words and
windows: sorted hashes of distinct windows, where in the block's word numbers each begins, and the items that have it.  One block is the rule.  A larger
benchmark takes a pass a block over the documents, which are then stored once with row numbers; a pass writes what it
hits, and only rows that may have a hit are joined with that, so results do not depend on the number of blocks.

Defined cases: a null or word-less text has no words, no hits and is clean; null item texts add nothing; items with
a null id hit as others do and count as one item, which the digest leaves out; repeated items count once per item id;
repeated documents are judged row by row; texts of any length are read whole, and an item is never cut; empty tables give
empty or all-clean results; extra columns are ignored by :func:`scan` and kept by :func:`clean`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.llm.base import materialize, maybe_in, slices, tidy

SIZE = 13
MEMORY = 384 << 20  # bytes of a block's set, in each worker
PER_WORD, PER_WINDOW, PER_ITEM = 160, 24, 64  # bytes of a distinct word (text, number, entry), of a window with its word and item, and of an item
SHARE = 20  # contaminated: hit words are at least one in SHARE

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_STR_LOWER = {c: c + 32 for c in range(65, 91)}
_MULTIPLIER = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


class NgramSet:
    """The windows of one benchmark block: numbers of words, all items' words as numbers, and by window length the sorted hashes
    of the windows with their places among those numbers."""

    def __init__(self, size: int):
        self.window, self.ids, self.items, self.parts = size, {}, [], []
        self.words = 0

    def add(self, item_id: int | None, text: str | None) -> None:
        if ws := words(text):
            self.items.append(item_id)
            self.parts.append(np.fromiter((self.ids.setdefault(w, len(self.ids) + 1) for w in ws), dtype=np.uint32, count=len(ws)))
            self.words += len(ws)

    def size(self) -> int:
        """About how many bytes this takes in memory."""
        return PER_WORD * len(self.ids) + PER_WINDOW * self.words + PER_ITEM * len(self.items)

    def sealed(self) -> NgramSet:
        lengths = np.array([len(p) for p in self.parts], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.sequence = np.concatenate([*self.parts, np.empty(0, dtype=np.uint32)])
        del self.parts
        # by length, of each distinct window: its hash, a place of it, and where its items begin among all items of windows
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        per = np.minimum(lengths, self.window)
        for n in np.unique(per).tolist():
            mine = np.flatnonzero(per == n)
            many = lengths[mine] - n + 1
            first = np.repeat(self.ends[mine] - lengths[mine] - np.cumsum(many) + many, many)
            at, item = first + np.arange(len(first)), np.repeat(mine, many)
            h = self._hash(self.sequence[at + j].astype(np.uint64) for j in range(n))
            order = np.lexsort((item, h))
            if not self._same(at[order], h[order], n)[h[order][1:] == h[order][:-1]].all():  # windows share a hash: their words part them
                order = np.lexsort((item, *[self.sequence[at + j] for j in reversed(range(n))], h))
            h, at, item = h[order], at[order], item[order]
            same = np.concatenate([[False], self._same(at, h, n)])
            # an item that has a window several times counts once
            once = ~(same & np.concatenate([[False], item[1:] == item[:-1]]))
            begins = np.flatnonzero(~same)
            counts = np.add.reduceat(once.astype(np.int64), begins)
            # a block has far fewer than 2**31 words
            self.windows[n] = (h[begins], *(x.astype(np.int32) for x in (at[begins], np.concatenate([[0], np.cumsum(counts)]), item[once])))
        return self

    def _same(self, at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Whether each window but the first is equal to the one before it."""
        same = h[1:] == h[:-1]
        for j in range(n):
            same &= self.sequence[at[1:] + j] == self.sequence[at[:-1] + j]
        return same

    @staticmethod
    def _hash(columns: Iterator[np.ndarray]) -> np.ndarray:
        h = np.uint64(0)
        for c in columns:
            h = (h + c) * np.uint64(_MULTIPLIER)
            h ^= h >> np.uint64(29)
        return h

    def find(self, ws: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """Which words are inside an occurrence of a window (None: none is), and the items that occur."""
        hit, items = None, set()
        if not self.windows or not ws:
            return hit, items
        ids = np.fromiter(map(self.ids.get, ws, repeat(0)), dtype=np.uint64, count=len(ws))
        known = np.zeros(len(ws) + 1, dtype=np.int64)
        np.cumsum(ids != 0, out=known[1:])
        for n, (hashes, places, starts, of) in self.windows.items():
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            h = self._hash(ids[at + j] for j in range(n))
            near = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            while len(at):  # once, but for windows that share a hash
                there = hashes[near] == h
                at, h, near = at[there], h[there], near[there]
                equal = np.ones(len(at), dtype=bool)
                for j in range(n):
                    equal &= self.sequence[places[near] + j] == ids[at + j]
                if equal.any():
                    if hit is None:
                        hit = np.zeros(len(ws), dtype=bool)
                    for j in range(n):
                        hit[at[equal] + j] = True
                    # each distinct window brings its items once a text
                    for k in np.unique(near[equal]).tolist():
                        items.update(map(self.items.__getitem__, of[starts[k] : starts[k + 1]].tolist()))
                rest = ~equal & (near + 1 < len(hashes))
                at, h, near = at[rest], h[rest], near[rest] + 1
        return hit, items


def blocks(items: Iterator[tuple[int | None, str | None]], size: int, memory: int) -> Iterator[NgramSet]:
    """The items in sets of at most about ``memory`` bytes (a single item may take more); one is built at a time."""
    held = NgramSet(size)
    for item_id, text in items:
        held.add(item_id, text)
        if held.size() > memory:
            yield held.sealed()
            held = NgramSet(size)
    yield held.sealed()


_HITS = "n_words long, hits binary, items array<long>"


def _hits(b: pa.RecordBatch, text: int, grams: NgramSet) -> list[pa.Array]:
    """The columns of _HITS for a batch whose texts are column ``text``."""
    n_words, hits, found = [], [], []
    for t in b.column(text):
        ws = words(t.as_py())
        hit, items = grams.find(ws)
        n_words.append(len(ws))
        hits.append(None if hit is None else np.packbits(hit).tobytes())
        found.append(sorted(items, key=lambda x: (x is None, x or 0)))
    return [pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64()))]


def _several(docs: DataFrame, sets: Iterator[NgramSet]) -> DataFrame:
    """``docs`` with the columns of _HITS from all of ``sets``, by a pass for each."""
    spark, columns = docs.sparkSession, docs.columns
    rows = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    found = None
    for grams in sets:
        held = spark.sparkContext.broadcast(grams)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                got = pa.RecordBatch.from_arrays([b.column(0), *_hits(b, 1, held.value)[1:]], names=["_row", "hits", "items"])
                yield got.filter(got.column(1).is_valid())

        part = materialize(rows.select("_row", "text").mapInArrow(tidy(run), "_row long, hits binary, items array<long>"), "decontaminate-hits")
        found = part if found is None else found.union(part)
        held.unpersist()
    # a list has an entry a block at most
    each = materialize(found.groupBy("_row").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "decontaminate-rows")
    ids = each.select("_row")
    none = maybe_in(rows, "_row", ids, keep=False).withColumns({"hits": F.lit(None).cast("array<binary>"), "items": F.lit(None).cast("array<long>")})
    some = maybe_in(rows, "_row", ids).join(each, "_row", "left").select(*none.columns)
    at = len(columns) + 1

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, hits = [len(words(t.as_py())) for t in b.column(columns.index("text"))], []
            for held in b.column(at).to_pylist():
                whole = None
                for h in held or ():
                    bits = np.frombuffer(h, dtype=np.uint8)
                    whole = bits if whole is None else whole | bits
                hits.append(None if whole is None else whole.tobytes())
            items = [sorted(x or (), key=lambda i: (i is None, i or 0)) for x in b.column(at + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: at - 1], pa.array(n_words, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.int64()))], names=[*columns, "n_words", "hits", "items"])

    return none.union(some).mapInArrow(tidy(merge), _with_hits(docs))


def _with_hits(docs: DataFrame) -> T.StructType:
    return T.StructType([*docs.schema.fields, *T._parse_datatype_string(_HITS).fields])


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], finish, schema, size: int = SIZE, memory: int = MEMORY) -> DataFrame:
    """Rows that ``finish`` makes from Arrow batches with the ``keep`` columns of ``docs`` in that order, then ``text``, ``n_words``,
    ``hits`` (a bitmap over the words, null: none hit) and ``items`` (sorted ids of the items that occur)."""
    texts = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    sets = blocks(((r["item_id"], r["text"]) for r in items.toLocalIterator()), size, memory)
    first, second = next(sets), next(sets, None)
    names = [*texts.columns, "n_words", "hits", "items"]
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                yield finish(pa.RecordBatch.from_arrays([*b.columns, *_hits(b, len(keep), held.value)], names=names))

        return texts.mapInArrow(tidy(run), schema)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(finish, batches)

    return _several(texts, chain([first, second], sets)).mapInArrow(tidy(finished), schema)


def _bits(hits: bytes | None) -> int:
    return int.from_bytes(hits, "big").bit_count() if hits else 0


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: counts, the digest of the occurring items, and the verdict."""

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        items = b.column(4).to_pylist()
        n_words, n_hit = b.column(2).to_pylist(), [_bits(h) for h in b.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                b.column(0),
                b.column(2),
                pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(str(i) for i in x if i is not None)).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 and SHARE * h >= n for h, n in zip(n_hit, n_words)], pa.bool_()),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], finish, schema, **options)


def cut_spans(text: str, hits: bytes) -> str:
    """``text`` without its hit words and what stands between two neighbouring hit words."""
    spans = [m.span() for m in _WORD.finditer(text.translate(_STR_LOWER))]
    hit = np.unpackbits(np.frombuffer(hits, dtype=np.uint8), count=len(spans)).astype(bool)
    out, at, i = [], 0, 0
    while i < len(spans):
        j = i
        while j < len(spans) and hit[j]:
            j += 1
        if j > i:
            out.append(text[at : spans[i][0]])
            at = spans[j - 1][1]
        i = max(j, i + 1)
    return "".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", **options) -> DataFrame:
    """``docs`` without contaminated rows (``document``), or with every hit span cut out of its text (``span``)."""
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode!r}")
    columns, place = docs.columns, docs.columns.index("text")
    # numbered names, so that no column of docs clashes with what scan adds
    plain = docs.toDF(*["text" if k == place else f"c{k}" for k in range(len(columns))])
    others = [c for c in plain.columns if c != "text"]
    order = [len(others) if k == place else others.index(f"c{k}") for k in range(len(columns))]

    def finish(b: pa.RecordBatch) -> pa.RecordBatch:
        n_words, hits = b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist()
        if mode == "document":
            b = b.filter(pa.array([not (n_hit := _bits(h)) or SHARE * n_hit < n for h, n in zip(hits, n_words)], pa.bool_()))
            texts = b.column(len(others))
        else:
            texts = pa.array([t if h is None else cut_spans(t, h) for t, h in zip(b.column(len(others)).to_pylist(), hits)], pa.string())
        return pa.RecordBatch.from_arrays([texts if k == place else b.column(order[k]) for k in range(len(columns))], names=columns)

    return scan(plain, benchmark, others, finish, docs.schema, **options)
