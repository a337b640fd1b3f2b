"""Cross-entropy difference: how much better a target model predicts a document than a matched background model.

Both are interpolated bigram models of the same order, smoothing and vocabulary; the vocabulary is the ``VOCABULARY``
most frequent words of the target texts, any other word is one unknown word.  Counts are exact and of all documents:
those of the target condition for the target model, all others for the background.  A document's own counts are left out of the
model that it is part of, so that members of either side are judged as strangers are.  The score is the mean over a document's
tokens of the target model's loss minus the background model's: the lower, the more it is like the target.

Texts are read once: their word numbers are stored in chunks of about ``CHUNK`` tokens.  A chunk sends each bigram it has, with
its counts, to the bucket of that bigram (a hash; there are so many buckets that each gets the bigrams of about ``BUCKET``
tokens).  A bucket adds up what all chunks sent and answers each with the totals of just the bigrams that it sent, in the
order that it sent them.  So a chunk has the counts of all its bigrams in an array beside it; nothing that grows with the
corpus is broadcast or collected, a frequent bigram costs an entry a chunk, and every step moves bytes in proportion to the
corpus.  Counts of words, of bounded size, are added up by a tree of tasks and broadcast.

Defined cases: a null or word-less text has no tokens and a null score; a target without texts gives an empty
vocabulary, so that all documents score alike; a null condition is background; rows that share an id are scored each, and what
one leaves out are the counts of its own row alone; of words that are equally frequent at the vocabulary's border those of the
smallest hashes are in; a side of one document is an even distribution to that document; a text of any length is one
document of one chunk, which then is as long as the text; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, materialize, sampled, slices, tidy

VOCABULARY = 50_000
BIGRAM, UNIGRAM = 0.7, 0.9  # weights of the bigram estimate, and of the unigram one against the uniform one
FLUSH = 500_000  # distinct words after which a task passes its counts on
CHUNK = 1_000_000  # tokens
BUCKET = 2_000_000  # tokens for each bucket of bigrams
ENTRIES = 16_384  # bigrams in a row of what is sent, at most
FAN = 32  # partial sums that one task adds up

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def vocabulary(target: DataFrame, size: int = VOCABULARY) -> list[bytes]:
    """The ``size`` most frequent words of all texts in ``target``, or all; of words that are equally frequent those of the smallest hashes.

    They are found by how many words have each count, and then how many of the last count have each leading part of a hash, so
    that no task orders all words.
    """

    def batch(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0):
                c.update(words(text.as_py()))
                if len(c) >= FLUSH:
                    yield batch(c)
                    c = Counter()
        yield batch(c)

    found = target.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "word binary, n long")
    counts = materialize(found.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")

    def least(rows: DataFrame, key: Column, room: int) -> tuple[int, int]:
        """The least key from which on there are at most ``room`` rows, and how many there are."""
        many = sorted(((r["key"], r["n"]) for r in rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).collect()), reverse=True)
        total, at = 0, None
        for k, n in many:
            if total + n > room:
                break
            total, at = total + n, k
        return (1 << 62 if at is None else at), total

    # by powers of two first, then by counts within the power where the room ends, of which there are few
    power = F.floor(F.log2("n")).cast("long")
    from_power, taken = least(counts, power, size)
    edge = counts.where(power < from_power).agg(F.max(power)).first()[0]
    edge = counts.where(power == (-1 if edge is None else edge))
    from_count, more = least(edge, F.col("n"), size - taken)
    kept = counts.where((F.col("n") >= from_count) | (power >= from_power)).collect()
    # the words of the next count fill what room is left, by hash
    last = edge.where(F.col("n") < from_count).agg(F.max("n")).first()[0]
    if (room := size - taken - more) > 0 and last is not None:
        tied = edge.where(F.col("n") == last)
        kept += sampled(tied, room, F.xxhash64("word", F.lit(31)), F.col("word")).collect()
    out = sorted(kept, key=lambda r: (-r["n"], bytes(r["word"])))
    discard(counts)
    return [bytes(r["word"]) for r in out]


class Chunk:
    """Documents one after another: their word numbers (0 is unknown), how many words each has, and which are of the target."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, is_target: np.ndarray, kinds: int):
        self.now, self.lengths, self.is_target, self.kinds = ids.astype(np.int64), lengths.astype(np.int64), is_target, kinds

    @property
    def before(self) -> np.ndarray:
        """The word before each; the last kind stands before a document's first."""
        before = np.empty_like(self.now)
        before[1:] = self.now[:-1]
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = self.kinds - 1
        return before

    @property
    def of_target(self) -> np.ndarray:
        return np.repeat(self.is_target, self.lengths)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct bigrams as numbers, in ascending order, and which of them each token is."""
        return np.unique(self.before * self.kinds + self.now, return_inverse=True)

    def own(self) -> tuple[np.ndarray, ...]:
        """Of each token how often its document has its bigram, its word and its context, and how many words the document has."""
        document = np.repeat(np.arange(len(self.lengths)), self.lengths)

        def often(of: np.ndarray, kinds: int) -> np.ndarray:
            _, which, n = np.unique(document * kinds + of, return_inverse=True, return_counts=True)
            return n[which]

        keys, which = self.bigrams()
        return often(which, max(1, len(keys))), often(self.now, self.kinds), often(self.before, self.kinds), np.repeat(self.lengths, self.lengths)

    def words(self) -> np.ndarray:
        """Counts by side (target first) of words, then of words as contexts."""
        out = []
        for side in (True, False):
            mine = self.of_target == side
            out += [np.bincount(self.now[mine], minlength=self.kinds), np.bincount(self.before[mine], minlength=self.kinds)]
        return np.stack(out)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)).astype(np.int64) % buckets


class Model:
    """Counts of one side: of words (0 is unknown) and of words as contexts (the last one is a text's start)."""

    def __init__(self, unigrams: np.ndarray, contexts: np.ndarray):
        self.unigrams, self.contexts = unigrams.astype(np.float64), contexts.astype(np.float64)
        self.total, self.kinds = float(unigrams.sum()), len(unigrams) - 1  # nothing is the start

    def losses(self, c: Chunk, counts: np.ndarray, own: tuple[np.ndarray, ...]) -> np.ndarray:
        """The loss of each token of a chunk, whose bigram occurs ``counts`` times on this side; ``own`` are a token's document's
        counts of its bigram, word and context, and its length, as far as it is part of this side."""
        bigram, word, context, length = own
        total = np.maximum(self.total - length, 0)
        p1 = UNIGRAM * (self.unigrams[c.now] - word) / np.maximum(total, 1) + (1 - UNIGRAM) / self.kinds
        p1 = np.where(total > 0, p1, 1 / self.kinds)
        seen = self.contexts[c.before] - context
        return -np.log(np.where(seen > 0, BIGRAM * (counts - bigram) / np.maximum(seen, 1) + (1 - BIGRAM) * p1, p1))


def chunks(docs: DataFrame, target: Column, ids: dict[bytes, int], columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """``docs`` as word numbers, a row a chunk, stored; ``rows`` has the ``columns`` of its documents."""
    held, width = docs.sparkSession.sparkContext.broadcast(ids), "<u2" if len(ids) + 2 <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        parts, lengths, targets, rows, size, number = [], [], [], [], 0, 0

        def done() -> pa.RecordBatch:
            whole = pa.concat_arrays(rows)
            listed = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            values = [b"".join(parts), np.array(lengths, dtype="<u4").tobytes(), np.array(targets, dtype=bool).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([first + number], pa.int64()), *[pa.array([v], pa.binary()) for v in values], listed], names=["chunk", "ids", "lengths", "targets", "rows"])

        for b in slices(batches):
            start = 0
            for i, (is_target, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                ws = words(text.as_py())
                parts.append(np.fromiter(map(held.value.get, ws, repeat(0)), dtype=width, count=len(ws)).tobytes())
                lengths.append(len(ws))
                targets.append(is_target)
                size += len(ws)
                if size >= chunk or len(lengths) >= chunk // 16 + 1:
                    rows.append(b.column(2).slice(start, i + 1 - start))
                    yield done()
                    start, number = i + 1, number + 1
                    parts, lengths, targets, rows, size = [], [], [], [], 0
            if start < b.num_rows:
                rows.append(b.column(2).slice(start))
        if lengths:
            yield done()

    rows = docs.select(F.coalesce(target, F.lit(False)).alias("is_target"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias("row"))
    schema = rows.select(F.lit(0).cast("long").alias("chunk"), *[F.lit(b"").alias(c) for c in ("ids", "lengths", "targets")], F.array("row").alias("rows")).schema
    return materialize(rows.mapInArrow(tidy(run), schema), "lm-chunks")


def _read(ids: bytes, lengths: bytes, targets: bytes, kinds: int) -> Chunk:
    n = np.frombuffer(lengths, dtype="<u4")
    return Chunk(np.frombuffer(ids, dtype="<u2" if kinds <= 1 << 16 else "<u4"), n, np.frombuffer(targets, dtype=bool), kinds)


def word_counts(stored: DataFrame, kinds: int, tasks: int) -> tuple[Model, Model]:
    """The target's model and the background's; ``tasks`` at most read ``stored``."""

    def batch(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, kinds), dtype=np.int64)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                total += _read(*row, kinds).words()
        yield batch(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, kinds), dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), dtype=np.int64).reshape(4, kinds)
        yield batch(total)

    sums = stored.select("ids", "lengths", "targets").mapInArrow(tidy(leaf), "counts binary")
    while tasks > 4:
        tasks = -(-tasks // FAN)
        sums = sums.repartition(tasks).mapInArrow(tidy(add), "counts binary")
    total = sum((np.frombuffer(bytes(r["counts"]), dtype=np.int64).reshape(4, kinds) for r in sums.collect()), np.zeros((4, kinds), dtype=np.int64))
    return Model(total[0], total[1]), Model(total[2], total[3])


def _packed(rows: Iterator[tuple], names: list[str], types: list) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += 64 + sum(len(x) for x in r if isinstance(x, bytes))
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def totals(stored: DataFrame, kinds: int, buckets: int, entries: int = ENTRIES) -> DataFrame:
    """``chunk``, ``bucket``, ``part``, ``good``, ``back`` and ``wide`` (numbers of 64 bits): of each chunk's distinct bigrams by bucket, in ascending order, how often
    they occur in all documents of the target and in all others."""

    short = "<u4" if kinds <= 1 << 16 else "<u8"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for number, *row in zip(*[c.to_pylist() for c in b.columns]):
                    c = _read(*row, kinds)
                    keys, which = c.bigrams()
                    good = np.bincount(which[c.of_target], minlength=len(keys))
                    back = np.bincount(which, minlength=len(keys)) - good
                    place = bucket_of(keys, buckets)
                    order = np.argsort(place, kind="stable")
                    keys, good, back, place = keys[order], good[order], back[order], place[order]
                    starts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
                    for lo, hi in zip(starts, [*starts[1:], len(place)]):
                        for part, i in enumerate(range(lo, hi, entries)):
                            j = min(i + entries, hi)
                            yield int(place[i]), number, part, keys[i:j].astype(short).tobytes(), good[i:j].astype("<u4").tobytes(), back[i:j].astype("<u4").tobytes()

        yield from _packed(rows(), ["bucket", "chunk", "part", "keys", "good", "back"], [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def replies(bucket: int, held: list[tuple]):
            keys, which = np.unique(np.concatenate([k for _, _, k, _, _ in held]), return_inverse=True)
            sums = []
            for side in (3, 4):
                total = np.zeros(len(keys), dtype=np.int64)
                np.add.at(total, which, np.concatenate([h[side] for h in held]).astype(np.int64))
                sums.append(total)
            wide, at = "<u8" if max(int(s.max()) for s in sums) >> 32 else "<u4", 0
            for chunk, part, k, *_ in held:
                mine = which[at : at + len(k)]
                yield chunk, bucket, part, *[s[mine].astype(wide).tobytes() for s in sums], wide == "<u8"
                at += len(k)

        def rows():
            last, held = None, []
            for b in batches:
                for bucket, chunk, part, keys, good, back in zip(*[c.to_pylist() for c in b.columns]):
                    if bucket != last:
                        if held:
                            yield from replies(last, held)
                        last, held = bucket, []
                    held.append((chunk, part, np.frombuffer(keys, dtype=short), np.frombuffer(good, dtype="<u4"), np.frombuffer(back, dtype="<u4")))
            if held:
                yield from replies(last, held)

        yield from _packed(rows(), ["chunk", "bucket", "part", "good", "back", "wide"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()])

    sent = stored.select("chunk", "ids", "lengths", "targets").mapInArrow(tidy(send), "bucket long, chunk long, part long, keys binary, good binary, back binary")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(answer), "chunk long, bucket long, part long, good binary, back binary, wide boolean")


def score(docs: DataFrame, target: Column, columns: list[str] | None = None, size: int = VOCABULARY, chunk: int = CHUNK, bucket_tokens: int = BUCKET, entries: int = ENTRIES) -> DataFrame:
    """``columns`` (default: doc_id), n_tokens, both cross-entropies in nats a token, and their difference as ``score``."""
    columns, spark = columns or ["doc_id"], docs.sparkSession
    is_target = F.coalesce(target, F.lit(False))
    ids = {w: k for k, w in enumerate(vocabulary(docs.where(is_target), size), 1)}
    kinds = len(ids) + 2  # the unknown word and a text's start
    stored = chunks(docs, target, ids, columns, chunk)
    tokens, many = stored.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-tokens // ((2 if kinds <= 1 << 16 else 4) * bucket_tokens)))
    models = spark.sparkContext.broadcast(word_counts(stored, kinds, many))
    names = ["rows", "n_tokens", "good", "back"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies: list[tuple] = []
        for b in batches:
            for i, (bucket, good, back, wide, ids, lengths, targets) in enumerate(zip(*[b.column(k).to_pylist() for k in range(2, 9)])):
                if bucket is not None:  # what a chunk was answered sorts before the chunk
                    replies.append((good, back, "<u8" if wide else "<u4"))
                    continue
                c = _read(ids, lengths, targets, kinds)
                keys, which = c.bigrams()
                order = np.argsort(bucket_of(keys, buckets), kind="stable")
                sums, own = [], c.own()
                for side, model in enumerate(models.value):
                    member = c.of_target == (side == 0)
                    counts = np.empty(len(keys), dtype=np.int64)
                    counts[order] = np.concatenate([np.empty(0, dtype=np.int64), *[np.frombuffer(r[side], dtype=r[2]).astype(np.int64) for r in replies]])
                    some, total = c.lengths > 0, np.zeros(len(c.lengths))
                    if some.any():
                        losses = model.losses(c, counts[which], tuple(x * member for x in own))
                        total[some] = np.add.reduceat(losses, (np.cumsum(c.lengths) - c.lengths)[some])
                    sums.append(total)
                replies = []
                values = b.column(9).slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([values, pa.array(c.lengths), *[pa.array(s) for s in sums]], names=names)

    whole = stored.select("chunk", F.lit(1).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "long"), ("good", "binary"), ("back", "binary"), ("wide", "boolean"))], "ids", "lengths", "targets", "rows", F.lit(0).cast("long").alias("part"))
    answers = totals(stored, kinds, buckets, entries).select("chunk", F.lit(0).alias("kind"), "bucket", "good", "back", "wide", *[F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in ("ids", "lengths", "targets", "rows")], "part")
    dealt = answers.union(whole).repartition("chunk").sortWithinPartitions("chunk", "kind", "bucket", "part")
    schema = stored.select(F.col("rows")[0].alias("rows"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("good"), F.lit(0.0).alias("back")).schema
    found = materialize(dealt.mapInArrow(tidy(run), schema), "lm-scores")
    discard(stored)
    loss = {c: F.when(F.col("n_tokens") > 0, F.col(x) / F.col("n_tokens")) for c, x in (("target_loss", "good"), ("background_loss", "back"))}
    out = found.select(*[F.col(f"rows.c{k}").alias(c) for k, c in enumerate(columns)], "n_tokens", *[e.alias(c) for c, e in loss.items()])
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
