"""Quality classification by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that is learnt from; negative labels are never used.  The class prior
is estimated from how far a positive-against-unlabelled classifier's scores can be explained by positives alone.  A small
network over dense features of whole texts (shares of kinds of characters, words and lines, repetition, and how much of a
text is made of the words that most trusted positives share) then minimises the non-negative unbiased risk ``pi*R_p(+) + max(0, R_u(-) - pi*R_p(-))`` with the sigmoid loss.

The training sample is bounded: at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled documents, those with the smallest
hashes of their ids.  Training takes ``STEPS`` steps.  Every document is scored on its whole text.

Defined cases: null and empty texts get the score of a text without words; without a positive or an unlabelled document
every score is 0.5; a document with conflicting labels is no trusted positive; rows that share an id are scored each, and
of a sampled id with several texts the smallest is learnt from; texts of any length are measured whole; extra columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import discard, fold, slices, tidy
from echolake.llm.texts import measured, sample_ids, sample_texts, score_texts

SAMPLE = 8_000
STEPS = 1_900  # of the descent along the PU risk, whatever the sample's size
COMMON = 300  # words that the most trusted positives have

_EDGE = ".,;:!?\"'()[]{}<>*_-|"
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r", b".,;:'\"-()", b"!?", b"|", b"#$%&*+=~^@", b"<>{}[]\\/_`"]
_MEMBER = np.zeros((256, len(_CLASSES) + 1), dtype=np.float64)
for _k, _c in enumerate(_CLASSES):
    _MEMBER[list(_c), _k] = 1
_MEMBER[128:, -1] = 1


def common_words(sample: DataFrame, most: int = COMMON) -> frozenset[str]:
    """The lower-cased words that the most documents of a bounded sample have; ties to the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            for text in b.column(0):
                seen.update({w for t in (text.as_py() or "").lower().split() if (w := t.strip(_EDGE))})
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    found = sample.select("text").mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return frozenset(r["word"] for r in found.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect())


def features(text: str, common: frozenset[str] = frozenset()) -> list[float]:
    """Dense features of a whole text: shares of byte classes, word and line statistics, repetition, shared words."""
    raw = text.encode()
    n = max(len(raw), 1)
    shares = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) @ _MEMBER / n
    words = text.split()
    m = max(len(words), 1)
    unique = len(set(words))
    lines = [x for x in text.split("\n") if x]
    k = max(len(lines), 1)
    letters = max(shares[0] + shares[1] + shares[-1], 1e-9)
    known = sum(w.strip(_EDGE) in common for w in text.lower().split()) if common else 0
    return [
        *shares.tolist(),
        *np.sqrt(shares).tolist(),
        math.log1p(len(words)),
        len(text) / m,
        unique / m,
        math.log1p(unique) / math.log1p(m),
        sum(map(eq, words, islice(words, 1, None))) / m,
        math.log1p(len(lines)),
        len(set(lines)) / k,
        math.log1p(len(words) / k),
        shares[1] / letters,
        shares[8] * n / m,
        float(not words),
        known / m,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Net:
    """One hidden layer, trained with Adam."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / math.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.p[0] + self.p[1])
        return h, h @ self.p[2] + self.p[3][0]

    def step(self, x: np.ndarray, h: np.ndarray, slope: np.ndarray, rate: float, decay: float) -> None:
        back = np.outer(slope, self.p[2]) * (1 - h * h)
        grads = [x.T @ back + decay * self.p[0], back.sum(0), h.T @ slope + decay * self.p[2], np.array([slope.sum()])]
        self.t += 1
        for p, g, m, v in zip(self.p, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _batches(xp: np.ndarray, xu: np.ndarray) -> int:
    return max(1, min(len(xp), len(xu)) // 256)


def _train(net: Net, xp: np.ndarray, xu: np.ndarray, slopes, epochs: int, rate: float, seed: int) -> None:
    """slopes: (scores of positives, of unlabelled) -> derivative of the risk by each score."""
    rng = np.random.default_rng(seed)
    batches = _batches(xp, xu)
    for e in range(epochs):
        op, ou = np.array_split(rng.permutation(len(xp)), batches), np.array_split(rng.permutation(len(xu)), batches)
        for ip, iu in zip(op, ou):
            x = np.vstack([xp[ip], xu[iu]])
            h, z = net.forward(x)
            net.step(x, h, np.concatenate(slopes(z[: len(ip)], z[len(ip) :])), rate * (1 - 0.8 * e / epochs), 1e-4)


def class_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """The share of positives among the unlabelled: the least ratio of the two groups' upper tails.

    Where scores are so high that only positives have them, the unlabelled tail is the prior times the positive tail.
    Thresholds with a thin positive tail are left out, and a deviation is added to each ratio.  It is at least what one more
    unlabelled document would be, and at most the rest.
    """
    cuts = np.quantile(sp, np.linspace(0.02, 0.8, 60))
    tail_p, tail_u = (sp[None] >= cuts[:, None]).mean(1), (su[None] >= cuts[:, None]).mean(1)
    slack = np.sqrt(tail_u * (1 - tail_u) / len(su) + tail_p * (1 - tail_p) / len(sp))
    least = 1 / (len(su) + 1)
    return float(np.clip(np.min((tail_u + slack) / np.maximum(tail_p, 1e-9)), least, 1 - least))


def _pu_slopes(prior: float):
    def slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gp, gu = _sigmoid(zp), _sigmoid(zu)  # loss as positive is 1 - g, as negative g
        dp, du = gp * (1 - gp) / len(zp), gu * (1 - gu) / len(zu)
        if gu.mean() - prior * gp.mean() >= 0:
            return -prior * dp - prior * dp, du
        return prior * dp, -du  # the negative part's estimate fell below nought: step back up along it

    return slopes


def _contrast(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (_sigmoid(zp) - 1) / len(zp), _sigmoid(zu) / len(zu)


class Quality:
    """Scores texts; ``net`` None means that there was nothing to learn from."""

    def __init__(self, net: Net | None, prior: float = 0.5, common: frozenset[str] = frozenset()):
        self.net, self.prior, self.common = net, prior, common

    @classmethod
    def learn(cls, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, common: frozenset[str] = frozenset()) -> Quality:
        if not len(positive) or not len(unlabelled):
            return cls(None)
        both = np.vstack([positive, unlabelled])
        mean, scale = both.mean(0), both.std(0) + 1e-6
        if prior is None:
            net = Net(mean, scale)
            xp, xu = net.scaled(positive), net.scaled(unlabelled)
            _train(net, xp[::2], xu[::2], _contrast, 30, 0.01, 1)
            rest = [x[1::2] if len(x) > 1 else x for x in (xp, xu)]
            prior = class_prior(net.forward(rest[0])[1], net.forward(rest[1])[1])
        net = Net(mean, scale)
        xp, xu = net.scaled(positive), net.scaled(unlabelled)
        _train(net, xp, xu, _contrast, 5, 0.01, 2)
        _train(net, xp, xu, _pu_slopes(prior), -(-STEPS // _batches(xp, xu)), 0.01, 3)
        net.m = net.v = None
        return cls(net, prior, common)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.net is None or not texts:
            return np.full(len(texts), 0.5)
        return _sigmoid(self.net.forward(self.net.scaled(np.array([features(t, self.common) for t in texts])))[1])


def train(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, modulus: int = 3, sample: int = SAMPLE) -> Quality:
    learn = fold(F.col("doc_id"), modulus) != held_out_fold
    sure = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    positive = sample_ids(sure, learn, sample, 11).select("doc_id", F.lit(1).alias("positive"), F.lit(0).alias("unlabelled"))
    unlabelled = sample_ids(docs.select("doc_id"), learn, sample, 12).select("doc_id", F.lit(0).alias("positive"), F.lit(1).alias("unlabelled"))
    ids = positive.union(unlabelled).groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    texts = sample_texts(docs, ids, "quality-sample")
    common = common_words(texts.where("positive = 1"))
    got = measured(texts, lambda doc_id, p, u, text: features(text, common), ["doc_id", "positive", "unlabelled"]).toArrow().to_pylist()
    discard(texts)
    got.sort(key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in got], dtype=np.float64).reshape(len(got), -1 if got else 0)
    side = lambda name: x[np.array([r[name] == 1 for r in got], dtype=bool)]
    return Quality.learn(side("positive"), side("unlabelled"), common=common)


def classify(docs: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` (default: doc_id), held_out, score and predicted of every document."""
    model = train(docs, labels)
    got = score_texts(docs, model, columns or ["doc_id"])
    return got.withColumns({"held_out": fold(F.col("doc_id"), 3) == 1, "predicted": (F.col("score") >= 0.5).cast("int")})
