"""WordPiece tokens and vectors of texts; the embedding model itself is pluggable."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of special tokens, limits, and the blocks of ideographs.
CLS, SEP, UNK = 101, 102, 100
MAX_TOKENS, MAX_WORD = 512, 100
KNOWN = 200_000  # words that a task remembers the ids of
_CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PUNCTUATION = r"\p{P}$+<=>^`|~"
_BLANK = r"\t\n\r\p{Zs}"


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, _UPPER, _LOWER)


def clean_text(text: Column) -> Column:
    """Without control and replacement characters; every white space becomes a blank."""
    spaced = F.regexp_replace(text, f"[{_BLANK}]", " ")
    return F.regexp_replace(spaced, r"[\x00\x{FFFD}\p{Cc}\p{Cf}]", "")


def pad_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CJK})", " $1 ")


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Words and single punctuation marks."""
    t = pad_cjk(clean_text(F.coalesce(text, F.lit(""))))
    return F.regexp_extract_all(ascii_lower(t) if lower else t, F.lit(f"[{_PUNCTUATION}]|[^ {_PUNCTUATION}]+"), F.lit(0))


def _tries(vocabulary: dict[str, int]) -> tuple[dict, dict]:
    """The pieces that begin a word and those that follow, character by character; the empty one stands for a piece's id."""
    tries: tuple[dict, dict] = ({}, {})
    for piece, i in vocabulary.items():
        for node, text in ((tries[0], piece), (tries[1], piece.removeprefix("##") if piece.startswith("##") else "")):
            for c in text:
                node = node.setdefault(c, {})
            if text:
                node[""] = i
    return tries


def wordpiece(vocabulary: dict[str, int]) -> Callable[[Column], Column]:
    """A column function: arrays of words to arrays of ids, greedily by the longest known piece.

    Arrow arrays come and go as they are; of each batch every distinct word is cut up once, and ids are gathered by arrays.  A
    word is walked down tries of the pieces, one for its beginning and one for what follows, so that each step is a look at one
    character; a task remembers the words that it has met.
    """
    begins, follows = _tries(vocabulary)
    known: dict[str, list[int]] = {}

    def ids(word: str) -> list[int]:
        out, at, n = [], 0, len(word)
        if n > MAX_WORD:
            return [UNK]
        while at < n:
            node, found, end = follows if at else begins, None, at
            for k in range(at, n):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    found, end = node[""], k + 1
            if found is None:
                return [UNK]
            out.append(found)
            at = end
        return out

    def remembered(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            found = ids(word)
            if len(known) < KNOWN:
                known[word] = found
        return found

    @F.arrow_udf("array<int>")
    def run(words: pa.Array) -> pa.Array:
        lengths = np.array(pa.compute.fill_null(pa.compute.list_value_length(words), 0), dtype=np.int64)
        coded = pa.compute.fill_null(words.flatten(), "").dictionary_encode()
        pieces = [remembered(w) for w in coded.dictionary.to_pylist()]
        counts = np.array([len(p) for p in pieces], dtype=np.int64)
        values, starts = np.array([i for p in pieces for i in p], dtype=np.int32), np.cumsum(counts) - counts
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = counts[which]
        at = np.repeat(starts[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(lengths)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[at], pa.int32()))

    return run


def first_words(words: Column, limit: int = MAX_TOKENS) -> Column:
    """As many words as :func:`encode` can keep; every word has an id at least."""
    return F.slice(words, 1, limit - 2)


def decode_bytes(raw: Column) -> Column:
    """Text of bytes that may be no valid UTF-8: every invalid sequence becomes a replacement character, which
    :func:`clean_text` drops."""
    return F.make_valid_utf8(raw.cast("string"))


def encode(ids: Column, limit: int = MAX_TOKENS) -> Column:
    """Start mark, at most ``limit - 2`` ids, end mark."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, limit - 2), F.array(F.lit(SEP)))


def hashing_embedder(dim: int = 64) -> Callable[[Column], Column]:
    """A stand-in for a model: signed hashed counts of words and character trigrams, normalised.  Null text gives null."""

    @F.pandas_udf("array<float>")
    def run(text: pd.Series) -> pd.Series:
        from zlib import crc32

        def one(t):
            if t is None:
                return None
            v = np.zeros(dim)
            for w in unicodedata.normalize("NFKC", t).lower().split():
                for g in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                    h = crc32(g.encode())
                    v[h % dim] += 1 if h >> 31 else -1
            return (v / (np.linalg.norm(v) + 1e-12)).astype(np.float32).tolist()

        return text.map(one)

    return run
