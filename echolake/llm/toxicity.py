"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon words and lexicon prefixes, how near second-person words stand, capitals, punctuation
and obfuscation.  The lexicons are learnt from the labelled sample: words and prefixes that occur almost only in toxic
documents.  Each half of the sample is measured with the lexicon of the other half, so that the trees see densities as
they will be on new texts; the final lexicon is that of both halves.  A quarter of the sample calibrates the trees.

The sample is bounded: at most ``SAMPLE`` labelled documents, those with the smallest hashes of their ids.  Every
document is scored on its whole text.

Defined cases: null and empty texts get the score of a text without words; without labels of both kinds every score is
the share of toxic labels (0 if there is none); a document with conflicting labels counts as toxic; rows that share an
id are scored each, and of a labelled id with several texts the smallest is learnt from; texts and words of any length
are read whole; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, fold, slices, tidy
from echolake.llm.texts import measured, sample_ids, sample_texts, score_texts

SAMPLE = 10_000
PREFIXES = range(3, 8)
MOSTLY = 0.8  # the share of a term's documents that are toxic, at least
CACHE, CACHED_CHARS = 100_000, 32  # tokens that a worker remembers the marks of, and how long they may be

SECOND_PERSON = frozenset("you your yours yourself yourselves u ur youre du dich dir dein deine deinen deiner ihr euch euer tu toi ton ta tes vous votre vos te ti tú tus usted ustedes vosotros vuestro".split())
_EDGE = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "¡¿«»“”‘’…–—"
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
_MIXED = re.compile(r"[^\W\d_][\d@$!*._\-]+[^\W\d_]")
_LONG = re.compile(r"([^\W\d_])\1\1")
WORD, PREFIX, SECOND, CAPITALS, MIXED, HIDDEN, LONG = (1 << k for k in range(7))


def _terms(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


class Lexicon:
    def __init__(self, terms):
        self.words = frozenset(t[1:] for t in terms if t[0] == "=")
        self.prefixes = frozenset(t[1:] for t in terms if t[0] == "^")
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.cache: dict[str, int] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def mark(self, token: str) -> int:
        bare = token.strip(_EDGE)
        word = bare.lower()
        marks = WORD * (word in self.words) | SECOND * (word in SECOND_PERSON) | CAPITALS * (len(bare) > 1 and bare.isupper())
        marks |= PREFIX * any(word[:k] in self.prefixes for k in self.lengths if len(word) >= k)
        if not word.isalpha() and _MIXED.search(token):
            plain = token.lower().translate(_PLAIN).strip(_EDGE)
            marks |= MIXED | HIDDEN * (plain in self.words or any(plain[:k] in self.prefixes for k in self.lengths if len(plain) >= k))
        elif _LONG.search(word):
            once = re.sub(r"(.)\1+", r"\1", word)
            marks |= LONG | HIDDEN * (once in self.words and not marks & WORD)
        if len(self.cache) < CACHE and len(token) <= CACHED_CHARS:
            self.cache[token] = marks
        return marks

    def features(self, text: str) -> list[float]:
        tokens = text.split()
        marks = list(map(self.cache.get, tokens))
        if None in marks:
            marks = [self.mark(t) if m is None else m for t, m in zip(tokens, marks)]
        a = np.array(marks, dtype=np.uint8)
        n = max(len(a), 1)
        count = [int(np.count_nonzero(a & (1 << k))) for k in range(7)]
        hits, second = np.flatnonzero(a & (WORD | PREFIX | HIDDEN)), np.flatnonzero(a & SECOND)
        near = 0
        if len(hits) and len(second):
            at = np.searchsorted(second, hits)
            left, right = second[np.maximum(at - 1, 0)], second[np.minimum(at, len(second) - 1)]
            near = int(np.count_nonzero(np.minimum(np.abs(hits - left), np.abs(right - hits)) <= 5))
        close = float(np.max(np.searchsorted(hits, hits + 100) - np.arange(len(hits)))) if len(hits) else 0.0
        letters = max(len(text), 1)
        return [
            count[0] / n,
            math.log1p(count[0]),
            count[1] / n,
            math.log1p(count[1]),
            len(hits) / n,
            close,
            float(len({tokens[i] for i in hits})),
            count[2] / n,
            near / n,
            near / max(len(hits), 1),
            count[3] / n,
            count[4] / n,
            count[5] / n,
            count[6] / n,
            text.count("!") / letters,
            text.count("?") / letters,
            math.log1p(len(tokens)),
        ]


def lexicon_counts(sample: DataFrame) -> DataFrame:
    """Of each word and prefix, in how many documents of either half of a sample it occurs, and in how many toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]
        for b in slices(batches):
            for half, toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                seen = {w for t in (text.as_py() or "").split() if (w := t.strip(_EDGE).lower())}
                terms = {t for w in seen for t in _terms(w)}
                counts[2 * half].update(terms)
                if toxic:
                    counts[2 * half + 1].update(terms)
        terms = list(counts[0].keys() | counts[2].keys())
        for i in range(0, len(terms), 20_000):
            part = terms[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts)], names=["term", "n0", "t0", "n1", "t1"])

    got = sample.select("half", "toxic", "text").mapInArrow(tidy(run), "term string, n0 long, t0 long, n1 long, t1 long")
    return got.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")])


class Trees:
    """Gradient boosting with logistic loss on histograms of quantile bins; trees are complete, as arrays."""

    def __init__(self, depth: int = 3, rounds: int = 80, rate: float = 0.15, bins: int = 48):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, d = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        for j in range(d):  # a few large values of an otherwise constant feature get cuts of their own
            if len(some := np.unique(x[x[:, j] != np.median(x[:, j]), j])):
                cuts[j] = np.unique(np.concatenate([cuts[j], np.quantile(some, np.linspace(0, 1, 9)), [some.min() - 1e-9]]))
        width = max(map(len, cuts)) + 1
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        offset = np.arange(d)[None] * width
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = math.log(rate / (1 - rate))
        z = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            inner = (1 << self.depth) - 1
            feature, cut, node = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                key = ((node - first)[:, None] * d * width + offset + binned).ravel()
                sums = [np.bincount(key, np.repeat(v, d), many * d * width).reshape(many, d, width).cumsum(2) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, [s[:, :, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = -1
                for k in range(many):
                    j, b = divmod(int(gain[k].argmax()), width)
                    if gain[k, j, b] > 1e-6 and b < len(cuts[j]):
                        feature[first + k], cut[first + k] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            self.trees.append((feature, cut, value))
            z += value[leaf]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of a non-decreasing map from raw scores to probabilities."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first and last raw score
    for s, t in zip(z[order].tolist(), y[order].tolist()):
        blocks.append([t, 1.0, s, s])
        while len(blocks) > 1 and (blocks[-2][3] == blocks[-1][2] or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            t2, w2, _, last = blocks.pop()
            blocks[-1][0] += t2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    at = [p for b in blocks for p in (b[2], b[3])]
    return np.array(at), np.repeat([b[0] / b[1] for b in blocks], 2)


class Toxicity:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray] | None, rate: float):
        self.lexicon, self.trees, self.knots, self.rate = lexicon, trees, knots, rate

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        z = self.trees.raw(np.array([self.lexicon.features(t) for t in texts]))
        # the isotonic map is flat in steps; a small strictly rising part keeps the trees' order within a step
        return 0.998 * np.interp(z, *self.knots) + 0.002 / (1 + np.exp(-np.clip(z, -40, 40)))


def _least(toxic: float) -> float:
    """How many toxic documents a term of the lexicon is in at least, of so many."""
    return max(3, 0.01 * toxic)


def _chosen(counts: list[tuple], toxic: int, columns: tuple[int, ...]) -> list[str]:
    least = _least(toxic)
    out = []
    for term, *c in counts:
        n, t = sum(c[2 * k] for k in columns), sum(c[2 * k + 1] for k in columns)
        if t >= least and t >= MOSTLY * n:
            out.append(term)
    return out


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 0, modulus: int = 5, sample: int = SAMPLE) -> Toxicity:
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = sample_ids(known, fold(F.col("doc_id"), modulus) != held_out_fold, sample, 21).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(2)).cast("int"))
    ids = docs.sparkSession.createDataFrame(ids.collect(), ids.schema)  # bounded by sample
    texts = sample_texts(docs, ids, "toxicity-sample")
    toxic = ids.where("toxic = 1").count()
    # what no lexicon can take stays out: a term is in at least this share of a half's toxic documents, so there are
    # at most 200 times as many as such a document has terms
    least, most = _least(toxic / 2), f"{MOSTLY} * n"
    counts = lexicon_counts(texts).where(f"(t0 >= {least} and t0 >= {most}0) or (t1 >= {least} and t1 >= {most}1) or (t0 + t1 >= {_least(toxic)} and t0 + t1 >= {MOSTLY} * (n0 + n1))")
    counts = [tuple(r) for r in counts.collect()]
    lexicons = [Lexicon(_chosen(counts, toxic / 2, (1,))), Lexicon(_chosen(counts, toxic / 2, (0,)))]
    rows = measured(texts, lambda doc_id, toxic, half, text: lexicons[half].features(text), ["doc_id", "toxic", "half"]).toArrow().to_pylist()
    discard(texts)
    rows.sort(key=lambda r: (r["doc_id"] * 2654435761 % 2**32, r["doc_id"]))
    x, y = np.array([r["features"] for r in rows], dtype=np.float64), np.array([r["toxic"] for r in rows], dtype=np.float64)
    rate = float(y.mean()) if len(y) else 0.0
    final = Lexicon(_chosen(counts, toxic, (0, 1)))
    if not 0 < y.sum() < len(y):
        return Toxicity(final, None, None, rate)
    # of each kind every fourth calibrates; where that leaves a side without one of the kinds, all rows do both
    place = np.empty(len(y), dtype=np.int64)
    for kind in (0, 1):
        place[y == kind] = np.arange(np.count_nonzero(y == kind))
    test = place % 4 == 3
    both = all(0 < y[side].sum() < np.count_nonzero(side) for side in (test, ~test))
    trees = Trees().fit(x[~test], y[~test]) if both else Trees().fit(x, y)
    knots = isotonic(trees.raw(x[test]), y[test]) if both else isotonic(trees.raw(x), y)
    return Toxicity(final, trees, knots, rate)


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), held_out, score and predicted of every document."""
    model = train(docs, labels)
    got = score_texts(docs, model, columns or ["doc_id"])
    return got.withColumns({"held_out": fold(F.col("doc_id"), 5) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})
