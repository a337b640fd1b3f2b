"""Packing of token sequences under several limits at once: tokens, segments and loss-bearing tokens.

An item is a run of tokens whose first ``prompt`` ones bear no loss, as an instruction before its reply; its demand is the
vector (tokens, one segment, loss-bearing tokens).  Items are dealt evenly by a hash to groups of bounded size.

Method.  A group fills one sequence after the other.  Of the items that fit whole, the one with the largest dot product of
demand and what the sequence has left is taken; both are shares of the limits, each dimension weighed by the group's mean
demand in it.  An empty sequence takes a full front of an item that is longer than the limit first.  Where no item fits, the
one whose front fills most of the room is cut there (unless ``cut`` is false), and its rest goes back; so it is as well for
the last segment of a sequence.  With ``powers`` a sequence that can't be filled ends at the largest power of two below its
length, where it needs no padding, and gives the tokens after that back.  So nothing is padded while items may be cut.

Items of equal demand are one class, and a step looks at classes only: a group costs its pieces times its classes.

Of documents, full fronts are cut off where they are encoded; ids are stored for the rests alone, and only those that were cut
are read back for their checksums, by a join behind a Bloom filter.

Defined cases: a null or empty text is the end id alone; repeated rows, ids included, are packed each; items of equal demand
are taken by their rows, the latest first; items of no tokens are left out; a prompt longer than its item is all of it; with ``cut``
false an item beyond a limit is an error; an empty table gives no rows; texts of any length are cut as often as needed; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, materialize, maybe_in, slices, tidy
from echolake.llm.packing import Encoder

END = 1
GROUP = 16_384  # most items that one task packs


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 128
    loss: int = 2048


class _Pool:
    """The items that are left, by class of (tokens, prompt)."""

    def __init__(self, tokens: np.ndarray, prompts: np.ndarray):
        classes, at = np.unique(np.stack([tokens, prompts], axis=1), axis=0, return_inverse=True)
        self.tokens, self.prompts = (np.ascontiguousarray(c) for c in classes.T)
        self.count = np.bincount(at.ravel(), minlength=len(classes))
        self.held = [[(i, 0) for i in part.tolist()] for part in np.split(np.argsort(at.ravel(), kind="stable"), np.cumsum(self.count)[:-1])]
        self.place = {(t, p): k for k, (t, p) in enumerate(classes.tolist())}
        self.left = len(tokens)

    def add(self, tokens: int, prompt: int, item: int, start: int) -> None:
        """``tokens`` of ``item`` from its token ``start`` on."""
        k = self.place.get((tokens, prompt))
        if k is None:
            k = self.place[tokens, prompt] = len(self.held)
            if k == len(self.tokens):  # room for as many again
                more = max(64, k)
                self.tokens, self.prompts, self.count = (np.concatenate([a, np.zeros(more, dtype=np.int64)]) for a in (self.tokens, self.prompts, self.count))
            self.tokens[k], self.prompts[k] = tokens, prompt
            self.held.append([])
        self.held[k].append((item, start))
        self.count[k] += 1
        self.left += 1

    def take(self, k: int) -> tuple[int, int, int, int]:
        self.count[k] -= 1
        self.left -= 1
        return int(self.tokens[k]), int(self.prompts[k]), *self.held[k].pop()


def dot_product_packing(tokens: np.ndarray, prompts: np.ndarray, limits: Limits = Limits(), cut: bool = True, powers: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, place) of every piece of the items, which are given by their tokens and prompts."""
    tokens, prompts = tokens.astype(np.int64), np.minimum(prompts, tokens).astype(np.int64)
    if not cut and len(tokens) and ((tokens > limits.tokens) | (tokens - prompts > limits.loss)).any():
        raise ValueError("an item is beyond a limit and may not be cut")
    if min(limits) < 1:
        raise ValueError("limits are at least 1")
    pool = _Pool(tokens, prompts)
    n = max(1, len(tokens))
    weight_t, weight_l = tokens.sum() / n / limits.tokens, (tokens - prompts).sum() / n / limits.loss
    out, sequence = [], 0
    while pool.left:
        room, seats, loss = limits
        held: list[tuple[int, int, int, int]] = []  # item, start, length, prompt within it
        while room and seats and pool.left:
            there = pool.count > 0
            bearing = pool.tokens - pool.prompts
            front = np.minimum(np.minimum(pool.tokens, room), pool.prompts + loss) * there  # the most that can be put here
            whole = (front == pool.tokens) & there
            # shares of the limits; a segment more is the same for all items and does not tell them apart
            score = (weight_t * room / limits.tokens**2) * pool.tokens + (weight_l * loss / limits.loss**2) * bearing
            long = not held and cut and (pool.tokens[there] > limits.tokens).any()
            if whole.any() and not long and not (seats == 1 and cut):
                k = int(np.where(whole, score, -1.0).argmax())
            elif cut:
                k = int(np.lexsort((score, whole, front))[-1])
                if not front[k]:
                    break
            else:
                break
            x = int(front[k])
            t, p, item, start = pool.take(k)
            if x < t:
                pool.add(t - x, max(0, p - x), item, start + x)
            held.append((item, start, x, min(p, x)))
            room, seats, loss = room - x, seats - 1, loss - max(0, x - p)
        length = limits.tokens - room
        if powers and cut and room:
            back = length - (1 << length.bit_length() - 1)
            while back:
                item, start, x, p = held.pop()
                given = min(back, x)
                pool.add(given, max(0, p - (x - given)), item, start + x - given)
                if x > given:
                    held.append((item, start, x - given, min(p, x - given)))
                back -= given
        at = 0
        for item, start, x, _ in held:
            out.append((item, start, x, sequence, at))
            at += x
        sequence += 1
    return out


def pack_items(items: DataFrame, limits: Limits = Limits(), cut: bool = True, powers: bool = True, group: int = GROUP) -> DataFrame:
    """Every piece of ``items`` (row, tokens, prompt and others, a row number being unique): its start within the item, length,
    sequence_id and offset, beside the item's columns."""
    columns = items.columns
    groups = max(1, -(-items.count() // group))
    dealt = items.where("tokens > 0").withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    added = {"_start": 0, "_length": 0, "_sequence": 0, "_place": 0}
    schema = items.withColumns({c: F.lit(v).cast("long") for c, v in added.items()}).schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        got = dot_product_packing(t.column("tokens").to_numpy(), t.column("prompt").to_numpy(), limits, cut, powers)
        item, start, length, sequence, place = np.array(got, dtype=np.int64).reshape(-1, 5).T
        sequence = sequence + (t.column("_group")[0].as_py() << 32)
        made = dict(zip(added, map(pa.array, (start, length, sequence, place))))
        return pa.table({c: t.column(c).take(pa.array(item)) for c in columns} | made)

    return dealt.groupBy("_group").applyInArrow(run, schema)


_loaded: dict = {}


def encoded(docs: DataFrame, path: str, limits: Limits, end: int) -> DataFrame:
    """row, doc_id, doc_tokens, the checksums of its full fronts, and the rest: start, tokens, ids and their checksum."""
    tail = np.array([end], dtype="<u4").tobytes()
    size = 4 * min(limits.tokens, limits.loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded.get(path) or _loaded.setdefault(path, Encoder(path))
        for b in slices(batches):
            out = []
            for text in b.column(2):
                ids = encode(text.as_py() or "") + tail
                cut = len(ids) // size * size
                rest = ids[cut:]
                out.append((len(ids) // 4, [zlib.crc32(ids[i : i + size]) for i in range(0, cut, size)], cut // 4, len(rest) // 4, rest, zlib.crc32(rest)))
            types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            made = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *made], names=["row", "doc_id", "doc_tokens", "fulls", "start", "tokens", "ids", "crc"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "row long, doc_id long, doc_tokens long, fulls array<long>, start long, tokens long, ids binary, crc long")


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end: int = END, **options) -> DataFrame:
    """Every piece of every document, all of whose tokens bear loss, with its sequence and its place there."""
    stored = materialize(encoded(docs, path, limits, end), "encoded", codec="zstd")
    size = min(limits.tokens, limits.loss)
    fulls = stored.select("doc_id", "doc_tokens", F.posexplode("fulls").alias("k", "ids_crc32"))
    fulls = fulls.withColumns({"start": F.col("k").cast("long") * size, "length": F.lit(size).cast("long"), "sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rests = stored.select("row", "doc_id", "doc_tokens", "start", "tokens", "crc", F.lit(0).cast("long").alias("prompt"))
    placed = materialize(pack_items(rests, limits, **options), "placed")
    whole = placed.where("_length = tokens").withColumn("ids_crc32", F.col("crc"))
    parts = placed.where("_length < tokens")
    ids = maybe_in(stored.select("row", "ids"), "row", parts.select("row").distinct())
    columns = parts.columns

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, n = (b.column(columns.index(c)).to_pylist() for c in ("_start", "_length"))
            crc = [zlib.crc32(x.as_py()[4 * i : 4 * (i + k)]) for x, i, k in zip(b.column(len(columns)), at, n)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(crc, pa.int64())], names=[*columns, "ids_crc32"])

    joined = parts.join(ids, "row").select(*columns, "ids")
    summed = joined.mapInArrow(tidy(checksum), whole.schema)
    rests = whole.unionByName(summed).withColumns({"start": F.col("start") + F.col("_start"), "length": F.col("_length"), "sequence_id": F.col("_sequence"), "offset": F.col("_place")})
    out = materialize(fulls.select(*_OUT).unionByName(rests.select(*_OUT)), "packed")
    discard(stored, placed)
    return out
