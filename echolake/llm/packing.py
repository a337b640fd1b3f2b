"""Best-fit packing of token sequences, with certified bounds.

Tokens.  A document is its ids plus one end id; only longer ones than ``capacity`` are cut, so that all pieces but the
first are full.  Full pieces are sequences of their own.  What is left is one piece of at most ``capacity`` tokens per
document at most, and these (a number and a length each) are what is packed.

Packing.  Pieces are dealt evenly by a hash to as few groups of bounded size as hold them.  Each group runs best-fit
decreasing and certifies its number of sequences against lower bounds from dual feasible functions.  The same bounds on
the histogram of all lengths certify the whole.  While the whole needs more than its bound, every group gives the documents
of its emptiest sequences back, four for each sequence over its own bound and four more; those of all groups are dealt
anew and best-fit decreasing runs again.  Rounds end when the bound is reached or a round saves no sequence, whose
predecessor then stands.

Defined cases: a null or empty text is the end id alone; repeated rows, ids included, are packed each; pieces of equal
length are packed in the order of their rows; an empty table gives no rows; a text of any length is cut into as many
pieces as it needs; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import count
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, materialize, slices, tidy

CAPACITY = 2048
END = 0
GROUP = 65_536  # most pieces that one task packs

#: Words that each Python worker remembers the ids of, and how long they may be; others are encoded each time.
CACHE, CACHED_CHARS = 200_000, 32

_WHITE = ("  ", " \n", " \t", " \r")
_RARE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0԰-\U0010ffff]")
_loaded: dict = {}


class Encoder:
    """Ids of a text by the byte-level vocabulary in ``path``, as little-endian unsigned 32-bit bytes.

    A single space before a visible character always begins a new piece of the vocabulary's own splitting pattern, so
    a text is the concatenation of its space-led words, whose ids are remembered.  Unknown words are encoded with the
    rank file of the same vocabulary (``<path>`` with the suffix ``.tiktoken``) where there is one, which is faster for
    short strings.  Texts with other white space after a space, rare characters or the strings of special tokens go to
    the full tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.full, self.cache = path, None, {}
        ranks = Path(path).with_suffix(".tiktoken")
        self.short = None
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.short = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def part(self, word: str) -> bytes:
        if not self.short:
            return self.whole(word)
        ids = array("I", self.short(word))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def by_words(self, text: str) -> bool:
        """Whether ``text`` is the concatenation of its space-led words."""
        return not (any(w in text for w in _WHITE) or text.endswith(" ") or "<|" in text or _RARE.search(text))

    def __call__(self, text: str) -> bytes:
        if not self.by_words(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        out = list(map(self.cache.get, rest))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = self.part(" " + rest[i])
                    if len(self.cache) < CACHE and len(rest[i]) <= CACHED_CHARS:
                        self.cache[rest[i]] = ids
        return (self.part(first) if first else b"") + b"".join(out)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``row`` (a number per row), doc_id, piece, start, length, ids_crc32 of every piece, and ``full_id`` (a negative number for a full piece, else null)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _loaded.get(path) or _loaded.setdefault(path, Encoder(path))
        for b in slices(batches):
            out = []
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = encode(text.as_py() or "") + tail
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    out.append((row, doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6, names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(tidy(run), "row long, doc_id long, piece long, start long, length long, ids_crc32 long")
    return got.withColumn("full_id", F.when(F.col("length") == capacity, -1 - F.monotonically_increasing_id()))


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that ``sizes`` need at least."""
    return bound_of(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def bound_of(count: np.ndarray, capacity: int) -> int:
    """Sequences that a histogram of sizes (from 0 to ``capacity``) needs at least: the best of several dual feasible functions."""
    count = count.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // capacity)
    above, weight = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    at_least = lambda a, k: int(a[k]) if k <= capacity else 0
    for low in range(1, capacity // 2 + 1):  # sizes over capacity - low count as whole, those under low as nothing
        whole = at_least(above, capacity - low + 1)
        middle = at_least(weight, low) - at_least(weight, capacity - low + 1)
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, 33):  # rounds to multiples of 1/k what is not one of 1/(k+1)
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    half = capacity // 2
    over = at_least(above, half + 1)  # no two of these share; the rest has only the room beside them
    rest, room = int((count[: half + 1] * x[: half + 1]).sum()), over * capacity - at_least(weight, half + 1)
    return max(best, over + max(0, -(-(rest - room) // capacity)))


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence of each size, its place there, and what each sequence lacks.  Longest first, each into the fullest sequence that has room."""
    order = np.argsort(-sizes, kind="stable")
    bins, places = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    free: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: some sequence lacks r tokens
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = mask >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = open_at[r].pop()
            if not open_at[r]:
                mask ^= 1 << r
        else:
            b, r = len(free), capacity
            free.append(r)
        bins[i], places[i] = b, capacity - r
        free[b] = r - size
        if r > size:
            open_at[r - size].append(b)
            mask |= 1 << (r - size)
    return bins, places, np.array(free, dtype=np.int64)


_PLACED = "row long, length long, sequence_id long, place long, given boolean"


def _round(items: DataFrame, groups: int, number: int, capacity: int) -> DataFrame:
    """Where each item goes, and whether its sequence is among the emptiest, which the group would give back."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        sizes = pdf["length"].to_numpy()
        bins, places, free = best_fit_decreasing(sizes, capacity)
        emptiest = np.argsort(-free, kind="stable")[: 4 * (len(free) - lower_bound(sizes, capacity)) + 4]
        ids = (number << 52) + (int(pdf["group"].iloc[0]) << 24) + bins
        return pd.DataFrame({"row": pdf["row"], "length": sizes, "sequence_id": ids, "place": places, "given": np.isin(bins, emptiest)})

    return items.withColumn("group", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups))).groupBy("group").applyInPandas(run, _PLACED)


def certificate(lengths: DataFrame, capacity: int = CAPACITY) -> int:
    """Sequences that all rows of ``lengths`` (column ``length``) need at least; a row per length comes to the driver."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in lengths.groupBy("length").agg(F.count("*")).collect():
        count[length] = n
    return bound_of(count, capacity)


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int | None = None, spent: list | None = None) -> DataFrame:
    """``row``, ``sequence_id`` and ``place`` of every (row, length) in ``items``; ``spent`` gets the stored tables that hold them.

    ``rounds`` sets an end to the exchange; by default it goes on as long as a round saves sequences.
    """
    items = items.select("row", "length")
    done, used, left, bound = None, 0, items.count(), certificate(items, capacity)
    before, least = None, None  # the round before, and how many sequences there are in all after it
    for number in count():
        groups = max(1, -(-left // group))
        placed = materialize(_round(items, groups, number, capacity), f"packing{number}")
        if spent is not None:
            spent.append(placed)
        # places begin at 0 in every sequence, once
        first = placed.where("place = 0").agg(F.count("*"), F.count(F.when(~F.col("given"), 1))).first()
        if least is not None and used + first[0] >= least:
            placed = before.where("given")  # nothing was saved: the documents stay where they were
        elif used + first[0] > bound and number + 1 != rounds:
            kept = placed.where("not given")
            done = kept if done is None else done.unionByName(kept)
            before, least = placed, used + first[0]
            items, used = placed.where("given").select("row", "length"), used + first[1]
            left = items.count()
            continue
        return (placed if done is None else done.unionByName(placed)).select("row", "sequence_id", "place")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, **options) -> DataFrame:
    """Every piece of every document with its sequence and its place there; places of a sequence leave no gap."""
    cut = materialize(pieces(docs, path, capacity, end), "pieces")
    spent: list[DataFrame] = []
    places = pack(cut.where("full_id is null"), capacity, spent=spent, **options).select("row", F.lit(0).cast("long").alias("piece"), "sequence_id", "place")
    short = cut.where("full_id is null").join(places, ["row", "piece"])
    full = cut.where("full_id is not null").withColumns({"sequence_id": F.col("full_id"), "place": F.lit(0).cast("long")})
    both = short.select(*full.columns).unionByName(full)
    out = both.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", F.col("place").alias("offset"))
    out = materialize(out, "packed")
    discard(cut, *spent)
    return out
