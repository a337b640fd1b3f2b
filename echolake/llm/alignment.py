"""Alignment of two tokenizers over a corpus, and how often each pair of their tokens is linked.

A byte-level vocabulary (A) encodes a space and the text, a piece vocabulary (B) the text, to which it adds the space.  Both
sequences then spell the same bytes.  Where tokens of both end at one byte, a group ends.  A link is a pair of tokens, one of
each side, whose bytes overlap; a document of n A tokens, m B tokens and g groups has n + m - g of them, since every stretch
between two neighbouring ends of either side lies in one token of each.

Method.  The tokens of every document are stored once.  A pair is one 64-bit number, the B id above the A id.  Tasks count the pairs of
their documents with ``np.unique`` and send each distinct one once, however often it occurs; a sort by ranges of pairs brings
equal ones together, where runs are summed and written as shards, two flat files of sorted pairs and of counts in the shared
folder.  The highest count of each B id is one number an id.  Then documents look their pairs up in the shards, which tasks map into
memory and search by halves, so that a task holds the pages it reads and no table of pairs.

Shards are written under a name of their task's own and then renamed, so a task that is repeated changes nothing.  In a folder
that isn't mounted as files, a task copies the shards it reads to its temporary folder first, and removes them when it ends.

Defined cases: a text that is null, empty, or whose tokens of either side do not spell a space and itself (as with the
character that B writes for a space) has no tokens: zeros and an empty digest; rows that share an id are rows of their
own; strings of special tokens are plain text; a table without tokens has no shards; an empty one gives no rows; extra columns are
ignored; texts of any length are aligned whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm.base import delete, discard, fresh_path, materialize, tidy
from echolake.llm.packing import CACHE, CACHED_CHARS, Encoder

SPACE = "▁"  # how B writes a space
BATCH = 1 << 20  # characters that a task aligns at once, or one longer text
KEPT = 1 << 22  # distinct pairs that a task holds before it sends them

_STORED = "doc_id long, a binary, b binary, n_groups long, groups_sha256 string"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Plain(Encoder):
    """An encoder that takes strings of special tokens as text."""

    def whole(self, text: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.path)
            self.full.encode_special_tokens = True
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class Pieces:
    """Ids of a text by the piece vocabulary in ``path``, as little-endian unsigned 32-bit bytes.

    Where no piece has a space inside, merges never cross a single space before a visible character, and a text is the
    concatenation of its words, whose ids are remembered.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.by_words = not any(SPACE in p[1:] and p.strip(SPACE) for p in pieces)
        self.cache: dict[str, bytes] = {}
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text), dtype="<u4").tobytes()

    def splits(self, text: str) -> bool:
        """Whether ``text``, which is not empty, is the concatenation of its words."""
        return self.by_words and not ("  " in text or text[0] == " " or text[-1] == " " or SPACE in text)

    def __call__(self, text: str) -> bytes:
        if not self.splits(text):
            return self.whole(text)
        words = text.split(" ")
        out = list(map(self.cache.get, words))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = ids = self.whole(words[i])
                    if len(self.cache) < CACHE and len(words[i]) <= CACHED_CHARS:
                        self.cache[words[i]] = ids
        return b"".join(out)


def byte_level(path: str) -> list[bytes]:
    """The bytes of every entry of a byte-level vocabulary; empty for ids that have none.

    Printable bytes stand for themselves in an entry, and the others, in order, for the characters from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    decoded = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    entries = held["model"]["vocab"] | {t["content"]: t["id"] for t in held.get("added_tokens", [])}
    out = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        if all(c in decoded for c in entry):
            out[i] = bytes(map(decoded.get, entry))
    return out


class Aligner:
    """Both tokenizers, and per id its bytes, their number, and how it is written in a group."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Plain(path_a), Pieces(path_b)
        self.bytes_a, self.bytes_b = byte_level(path_a), self.b.bytes
        self.sizes = [np.array(list(map(len, t)), dtype=np.int64) for t in (self.bytes_a, self.bytes_b)]
        # within a group, at the end of its A side, within its B side, at its end
        self.words: dict[str, tuple] = {}
        self.written = [str(i).encode() + end for side, ends in ((self.bytes_a, b",|"), (self.bytes_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(len(side))]

    def tokens(self, text: str | None) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        a, b = self.a(" " + text), self.b(text)
        return (a, b) if self.spelled(a, b, (" " + text).encode()) else (b"", b"")

    def aligned(self, a: np.ndarray, b: np.ndarray) -> Alignment:
        """All links of two token sequences that spell the same bytes; those of several documents may be strung together."""
        ends_a, ends_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        marks = np.zeros((2, (ends_a[-1] if len(ends_a) else 0) + 1), dtype=bool)
        marks[0, ends_a] = marks[1, ends_b] = True
        ends = np.flatnonzero(marks[0] | marks[1])
        at_a, at_b = marks[0, ends], marks[1, ends]
        # the token of a stretch is that whose end comes next
        return Alignment(ends, np.cumsum(at_a) - at_a, np.cumsum(at_b) - at_b, at_a & at_b)

    def document(self, text: str | None) -> tuple[bytes, bytes, int, str]:
        """The tokens of both sides of a text, how many groups it has, and the digest of them all.

        Where both sides are the concatenations of a text's words, so are the groups, and those of a word are remembered.
        """
        if text and self.b.splits(text) and self.a.by_words(" " + text):
            words = text.split(" ")
            found = list(map(self.words.get, words))
            if None in found:
                new = self.learnt([w for w, known in zip(words, found) if known is None])
                found = [new[w] if known is None else known for w, known in zip(words, found)]
            if all(found):
                a, b, groups = map(b"".join, zip(*found))
                return a, b, groups.count(b";"), hashlib.sha256(groups[:-1]).hexdigest()
        a_ids, b_ids = self.tokens(text)
        if not a_ids:
            return b"", b"", 0, ""
        groups = b"".join(self.pieces(a_ids, b_ids))
        return a_ids, b_ids, groups.count(b";"), hashlib.sha256(groups[:-1]).hexdigest()

    def learnt(self, words: list[str]) -> dict[str, tuple]:
        """The tokens of both sides and the groups of space-led words; nothing where a side spells one otherwise."""
        new = list(dict.fromkeys(words))
        spelled = " " + " ".join(new)
        # strung together they are a text that both sides split at its words, whose ends are ends of tokens
        a, b, wanted = self.a.part(spelled), self.b.whole(spelled[1:]), spelled.encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in new])
        made: dict[str, tuple] = {}
        if self.spelled(a, b, wanted):
            reached = [np.cumsum(size[np.frombuffer(ids, dtype="<u4")]) for size, ids in zip(self.sizes, (a, b))]
            at = [np.searchsorted(r, ends) for r in reached]
            if all((r[k] == ends).all() for r, k in zip(reached, at)):
                written, (to_a, to_b) = self.pieces(a, b), ((k + 1).tolist() for k in at)
                for w, i, j, k, m in zip(new, [0, *to_a], to_a, [0, *to_b], to_b):
                    made[w] = a[4 * i : 4 * j], b[4 * k : 4 * m], b"".join(written[i + k : j + m])
        if not made:
            for w in new:
                ids = self.a.part(" " + w), self.b.whole(w)
                made[w] = (*ids, b"".join(self.pieces(*ids))) if self.spelled(*ids, (" " + w).encode()) else ()
        for w, known in made.items():
            if len(self.words) < CACHE and len(w) <= CACHED_CHARS:
                self.words[w] = known
        return made

    def spelled(self, a: bytes, b: bytes, wanted: bytes) -> bool:
        return all(b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())) == wanted for ids, table in ((a, self.bytes_a), (b, self.bytes_b)))

    def pieces(self, a_ids: bytes, b_ids: bytes) -> list[bytes]:
        """The tokens of both sides as they are written, group by group, each with what ends it."""
        a, b = (np.frombuffer(x, dtype="<u4").astype(np.int64) for x in (a_ids, b_ids))
        found = self.aligned(a, b)
        shut = np.flatnonzero(found.both)
        per_a, per_b = found.of_a[shut], found.of_b[shut]  # the last token of either side in each group
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        code_a, code_b = a.astype(np.int64), b + 2 * n_a
        code_a[per_a] += n_a
        code_b[per_b] += n_b
        group_a, group_b = np.searchsorted(per_a, np.arange(len(a))), np.searchsorted(per_b, np.arange(len(b)))
        codes[np.arange(len(a)) + np.concatenate([[0], per_b + 1])[group_a]] = code_a
        codes[np.arange(len(b)) + (per_a + 1)[group_b]] = code_b
        return list(map(self.written.__getitem__, codes.tolist()))


class Alignment(NamedTuple):
    ends: np.ndarray  # where stretches end, in bytes
    of_a: np.ndarray  # the token of either side that each stretch lies in
    of_b: np.ndarray
    both: np.ndarray  # whether tokens of both sides end there


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _chunks(batches: Iterator[pa.RecordBatch], weight) -> Iterator[pa.RecordBatch]:
    """Rows in pieces of about :data:`BATCH` of ``weight`` (numbers, one a row of a batch), or one row."""
    for b in batches:
        reached = np.cumsum(weight(b)) // BATCH
        borders = np.concatenate([[0], np.flatnonzero(np.diff(reached)) + 1, [b.num_rows]])
        for i, j in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if j > i:
                yield b.slice(i, j - i)


def _lengths(column: pa.Array) -> np.ndarray:
    return pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, the tokens of both sides, n_groups and groups_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        for b in _chunks(batches, lambda b: _lengths(b.column(1))):
            out = [aligner.document(text.as_py()) for text in b.column(1)]
            made = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", "a", "b", "n_groups", "groups_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _STORED)


def _linked(aligner: Aligner, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents of a batch: their numbers of A tokens and of B tokens, the pair of every link, in order, and where each document's links end."""
    many, ids = [], []
    for name in "ab":
        column = b.column(b.schema.get_field_index(name))
        many.append(_lengths(column) // 4)
        ids.append(np.frombuffer(b"".join(x.as_py() for x in column), dtype="<u4").astype(np.int64))
    found = aligner.aligned(*ids)
    pairs = ids[1][found.of_b] << 32 | ids[0][found.of_a]
    # a document ends with its last A token, so its last stretch is the one with that token's end
    last = np.searchsorted(found.of_a, np.cumsum(many[0]))
    return many[0], many[1], pairs, last


def partial_counts(stored: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair and n: each distinct pair of a task's documents once, or as often as its table was full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pairs, counts = _aligner(path_a, path_b), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

        def sent() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (pairs, counts)], names=["pair", "n"])

        for b in _chunks(batches, lambda b: _lengths(b.column(0)) + _lengths(b.column(1))):
            more, n = np.unique(_linked(aligner, b)[2], return_counts=True)
            pairs, at = np.unique(np.concatenate([pairs, more]), return_inverse=True)
            # sums of whole numbers below 2**53, so doubles hold them
            counts = np.bincount(at, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
            if len(pairs) >= KEPT:
                yield from sent()
                pairs, counts = pairs[:0], counts[:0]
        yield from sent()

    return stored.select("a", "b").mapInArrow(tidy(run), "pair long, n long")


@contextmanager
def _mapped(uri: str, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Files of 64-bit numbers in the shared folder, mapped into memory."""
    store, path = pa.fs.FileSystem.from_uri(uri)
    local, held = path, None
    if not isinstance(store, pa.fs.LocalFileSystem):
        local = held = tempfile.mkdtemp()
        for name in names:
            pa.fs.copy_files(f"{path}/{name}", f"{held}/{name}", source_filesystem=store)
    try:
        yield [np.memmap(f"{local}/{name}", dtype="<i8", mode="r") for name in names]
    finally:
        if held:
            shutil.rmtree(held, ignore_errors=True)


def _write(uri: str, name: str, chunks: list[bytes]) -> None:
    """A file in the shared folder that is there as a whole or not at all."""
    store, path = pa.fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(draft) as out:
        for c in chunks:
            out.write(c)
    store.move(draft, f"{path}/{name}")


def shards(counts: DataFrame, uri: str) -> DataFrame:
    """Writes the sums of ``n`` by pair as sorted shards under ``uri``; a row a shard: its number, first and last pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [], None  # sums that are done, and the pair that may go on
        for b in batches:
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(pair):
                continue
            begins = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            keys, sums = pair[begins], np.add.reduceat(n, begins)
            if open_ is not None:
                if keys[0] == open_[0]:
                    sums[0] += open_[1]
                else:
                    held.append((np.array([open_[0]]), np.array([open_[1]])))
            open_ = (keys[-1], sums[-1])
            held.append((keys[:-1], sums[:-1]))
        if open_ is None:
            return
        keys, sums = (np.concatenate([*(h[k] for h in held), [open_[k]]]).astype("<i8") for k in (0, 1))
        number = TaskContext.get().partitionId()
        for kind, values in (("pairs", keys), ("counts", sums)):
            _write(uri, f"{kind}-{number:06d}", [values.data])
        # the highest count of each B id in this shard
        of, begins = np.unique(keys >> 32, return_index=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int32()), pa.array([int(keys[0])]), pa.array([int(keys[-1])]), pa.array([of.tolist()]), pa.array([np.maximum.reduceat(sums, begins).tolist()])], names=["shard", "first", "last", "b", "highest"]
        )

    return counts.repartitionByRange("pair").sortWithinPartitions("pair").mapInArrow(tidy(run), "shard int, first long, last long, b array<long>, highest array<long>")


def looked_up(stored: DataFrame, uri: str, listed: list[tuple[int, int, int]], highest: np.ndarray, path_a: str, path_b: str) -> DataFrame:
    """Every document with its counts; ``listed`` has the shards (number, first and last pair) in order, ``highest`` a count a B id."""
    best = stored.sparkSession.sparkContext.broadcast(highest)
    firsts = np.array([f for _, f, _ in listed], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(path_a, path_b)
        with _mapped(uri, [f"{kind}-{number:06d}" for number, _, _ in listed for kind in ("pairs", "counts")]) as files:
            for b in _chunks(batches, lambda b: _lengths(b.column(1)) + _lengths(b.column(2))):
                n_a, n_b, pairs, last = _linked(aligner, b)
                keys, at = np.unique(pairs, return_inverse=True)
                counts = np.zeros(len(keys), dtype=np.int64)
                of = np.searchsorted(firsts, keys, side="right") - 1
                for k in np.unique(of).tolist():
                    some = np.flatnonzero(of == k)
                    counts[some] = files[2 * k + 1][np.searchsorted(files[2 * k], keys[some])]
                leads = counts == best.value[keys >> 32] if len(keys) else counts > 0
                ends = [np.concatenate([[0], np.cumsum(v[at])])[last] for v in (counts, leads.astype(np.int64))]
                total, n_best = (np.diff(e, prepend=0) for e in ends)
                links = np.diff(last, prepend=0)
                made = [pa.array(c, pa.int64()) for c in (n_a, n_b, links, n_best, total)]
                yield pa.RecordBatch.from_arrays([b.column(0), *made[:2], b.column(3), *made[2:], b.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return stored.mapInArrow(tidy(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of its file system, as tasks need it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document n_a, n_b, n_groups, n_links, n_best (links whose count is the highest of their B id), count_sum and groups_sha256."""
    spark = docs.sparkSession
    stored = materialize(encoded(docs, path_a, path_b), "tokens", codec="zstd")
    uri = _qualified(spark, fresh_path(spark, "pair-shards"))
    # a row a shard, with a number for each B id in it
    written = materialize(shards(partial_counts(stored, path_a, path_b), uri), "shard-list")
    listed = [tuple(r) for r in written.select("shard", "first", "last").orderBy("first").collect()]
    tops = written.select(F.explode(F.arrays_zip("b", "highest")).alias("x")).groupBy("x.b").agg(F.max("x.highest")).collect()  # a row a B id
    highest = np.zeros(max((b for b, _ in tops), default=0) + 1, dtype=np.int64)
    for b, n in tops:
        highest[b] = n
    out = materialize(looked_up(stored, uri, listed, highest, path_a, path_b), "aligned")
    discard(stored, written)
    delete(spark, uri)  # not written by Spark, but in the folder of its name
    return out
