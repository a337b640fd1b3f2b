"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

One- to three-character n-grams of the lower-cased text (other characters than letters become single spaces) are features
by themselves, without hashing: those that occur in at least ``LEAST`` documents of the training sample, of which the
``FEATURES`` most frequent.  Inverse document frequencies are counted over every document of the training folds.  The weights
are learnt by follow-the-regularised-leader with elastic-net penalties (the first keeps weights at nought, the second
shrinks them) in ``EPOCHS`` passes.  A temperature calibrates the probabilities: each half of the sample is predicted by a
model of the other half, and the temperature is that of the least loss over both.

The training sample is bounded: ``SAMPLE`` documents in expectation, of each language its share of them and ``RARE`` at least (all,
if it has fewer), those whose ids hash below the language's share.  Every document is predicted from its whole text.

Defined cases: texts that are null, empty or have no letter are ``und`` with score 0, as are all where nothing could be
learnt; a text with none of the features gets equal probabilities and the first language of these; a sample in one
language predicts it with score 1; rows that share an id are predicted each, and of a sampled id the smallest language and
text are learnt from; texts of any length are read whole, in pieces that overlap; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, fold, slices, tidy
from echolake.llm.texts import sample_texts

SAMPLE = 6_000
RARE = 200
LEAST = 2
FEATURES = 1 << 17
EPOCHS = 4  # passes over the sample, whatever its size
CHUNK = 1 << 20  # characters at once
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _letter_runs(text: str) -> np.ndarray | None:
    """Code points of the lower-cased text with a single space around and between runs of letters; None without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
    letter = np.empty(len(codes) + 2, dtype=bool)
    letter[0] = letter[-1] = False
    letter[1:-1] = _letters()[codes]
    if not letter.any():
        return None
    padded = np.full(len(codes) + 2, 32, dtype=np.uint64)
    np.copyto(padded[1:-1], codes, where=letter[1:-1])
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after a word
    keep[0] = True
    return padded[keep]


def ngrams(text: str) -> Iterator[np.ndarray]:
    """The n-grams of one, two and three characters as numbers, 21 bits a character, in pieces; nothing for a text without letters."""
    one = _letter_runs(text)
    for i in range(0, 0 if one is None else len(one), CHUNK):  # n-grams belong where they begin, so pieces overlap by two
        part = one[i : i + CHUNK + 2]
        two = part[:-1] << np.uint64(21) | part[1:]
        three = two[:-1] << np.uint64(21) | part[2:]
        yield np.concatenate([part[:CHUNK], two[:CHUNK], three[:CHUNK]])


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


class Features:
    """Numbers of n-grams: a table with open addresses, searched for many at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.sort(keys)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.table, self.number = np.zeros(1 << self.bits, dtype=np.uint64), np.zeros(1 << self.bits, dtype=np.int32)
        waiting, at = np.arange(len(keys)), _slot(self.keys, self.bits)
        while True:
            if not len(waiting) or int(at.max()) >= len(self.table) - 1:  # the last place stays free
                self.table, self.number = np.append(self.table, np.zeros(64, dtype=np.uint64)), np.append(self.number, np.zeros(64, dtype=np.int32))
            if not len(waiting):
                break
            free = self.table[at] == 0
            place, first = np.unique(at[free], return_index=True)  # of several for a place the first gets it
            took = waiting[free][first]
            self.table[place], self.number[place] = self.keys[took], took
            left = ~np.isin(waiting, took)
            waiting, at = waiting[left], at[left] + 1

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each, or the number of features for what is none."""
        at = _slot(keys, self.bits)
        held = self.table[at]
        found = np.where(held == keys, self.number[at], len(self)).astype(np.int32)
        rest = np.flatnonzero((held != keys) & (held != 0))
        at = at[rest]
        while len(rest):
            at = at + 1
            held = self.table[at]
            same = held == keys[rest]
            found[rest[same]] = self.number[at[same]]
            on = ~same & (held != 0)
            rest, at = rest[on], at[on]
        return found

    def counts(self, text: str) -> np.ndarray | None:
        """How often each feature occurs; None for a text without letters."""
        total = None
        for keys in ngrams(text):
            n = np.bincount(self.find(keys), minlength=len(self) + 1)[: len(self)]
            total = n if total is None else total + n
        return total


def choose(sample: DataFrame, most: int = FEATURES, least: int = LEAST) -> np.ndarray:
    """The n-grams of the most documents of a sample, counted by its tasks; ties to the smaller number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        for b in slices(batches):
            for text in b.column(0):
                parts = [np.unique(k) for k in ngrams(text.as_py() or "")]
                if parts:
                    both = np.concatenate([keys, np.unique(np.concatenate(parts))])
                    keys, which = np.unique(both, return_inverse=True)
                    n = np.bincount(which, np.concatenate([n, np.ones(len(both) - len(n), dtype=np.int64)]), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000].astype(np.int64)), pa.array(n[i : i + 50_000])], names=["key", "n"])

    found = sample.select("text").mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = found.where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(most).select("key").toArrow()
    return top.column(0).to_numpy().astype(np.uint64)


def frequencies(docs: DataFrame, features: Features) -> tuple[int, np.ndarray]:
    """How many rows of ``docs`` have letters, and how many have each feature: all rows, added up in each task."""
    held = docs.sparkSession.sparkContext.broadcast(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 1, dtype=np.int64)
        for b in slices(batches):
            for text in b.column(0):
                c = held.value.counts(text.as_py() or "")
                if c is not None:
                    total[:-1] += c > 0
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(tidy(run), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(features) + 1, dtype=np.int64)
    total[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return int(total[-1]), total[:-1]


def examples(sample: DataFrame, features: Features) -> list[tuple[int, str, np.ndarray, np.ndarray]]:
    """doc_id, language, features and their counts of the documents of a sample that have letters."""
    held = sample.sparkSession.sparkContext.broadcast(features)
    names = ["doc_id", "lang", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                c = held.value.counts(text.as_py() or "")
                if c is not None:
                    at = np.flatnonzero(c)
                    out.append((doc_id, lang, at.astype("<i4").tobytes(), np.minimum(c[at], 2**31 - 1).astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.string(), pa.binary(), pa.binary()])], names=names)

    got = sample.select("doc_id", "lang", "text").mapInArrow(tidy(run), "doc_id long, lang string, at binary, n binary").toArrow().to_pylist()
    return [(r["doc_id"], r["lang"], np.frombuffer(r["at"], dtype="<i4"), np.frombuffer(r["n"], dtype="<i4")) for r in got]


def sample_of(rows: DataFrame, sample: int = SAMPLE, rare: int = RARE) -> DataFrame:
    """doc_id and lang of the training sample, from rows of (doc_id, lang): of each language those whose ids hash below its share."""
    rows = rows.where("doc_id is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    total = max(1, sum(sizes.values()))
    parts = [(lang, min(1.0, max(min(rare, n), sample * n // total) / n)) for lang, n in sizes.items()]
    parts = rows.sparkSession.createDataFrame(parts, "lang string, part double")
    few = rows.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) < F.col("part") * (1 << 30))
    return few.groupBy("doc_id").agg(F.min("lang").alias("lang"))


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for several classes."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, cells=slice(None)) -> np.ndarray:
        z, n = self.z[cells], self.n[cells]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, cells: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(cells)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p
        n = self.n[cells]
        self.z[cells] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[cells] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Languages:
    def __init__(self, names: list[str], features: Features | None = None, idf: np.ndarray | None = None, weights: np.ndarray | None = None, temperature: float = 1.0):
        self.names, self.features, self.idf, self.weights, self.temperature = names, features, idf, weights, temperature

    def predict(self, text: str) -> tuple[str, float]:
        if not self.names or len(self.names) == 1:
            return (self.names[0], 1.0) if self.names and _letter_runs(text) is not None else (UNKNOWN, 0.0)
        c = self.features.counts(text)
        if c is None:
            return UNKNOWN, 0.0
        at = np.flatnonzero(c)
        x = c[at] * self.idf[at]
        p = softmax(x @ self.weights[at] / (max(float(np.linalg.norm(x)), 1e-12) * self.temperature))
        k = int(p.argmax())
        return self.names[k], float(p[k])


def train(docs: DataFrame, held_out_fold: int = 2, modulus: int = 4, sample: int = SAMPLE, epochs: int = EPOCHS) -> Languages:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    rows = docs.where(fold(F.col("doc_id"), modulus) != held_out_fold)
    texts = sample_texts(rows, sample_of(rows.select("doc_id", "lang"), sample), "language-sample")
    features = Features(choose(texts))
    found = examples(texts, features)
    discard(texts)
    names, drawn = sorted({lang for _, lang, _, _ in found}), []
    if len(names) < 2:
        return Languages(names)
    n, df = frequencies(rows, features)
    idf = np.log((1 + n) / (1 + df)) + 1
    for _, lang, at, c in sorted(found, key=lambda t: (t[0] * 2654435761 % 2**32, t[0])):
        x = c * idf[at]
        drawn.append((at, x / max(float(np.linalg.norm(x)), 1e-12), names.index(lang)))

    def learnt(some: list) -> np.ndarray:
        model = Ftrl(len(features), len(names))
        for _ in range(epochs):
            for at, x, label in some:
                model.learn(at, x, label)
        return model.weights()

    z, y = [], []
    for side in (0, 1):
        weights = learnt(drawn[1 - side :: 2])
        z += [x @ weights[at] for at, x, _ in drawn[side::2]]
        y += [label for *_, label in drawn[side::2]]
    z, y, grid = np.array(z), np.array(y), np.geomspace(0.02, 10, 80)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    # of equal losses, as where a half had nothing to tell, the mildest temperature
    temperature = float(grid[np.lexsort((np.abs(np.log(grid)), np.round(loss, 9)))[0]])
    return Languages(names, features, idf, learnt(drawn), temperature)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [model.value.predict(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
