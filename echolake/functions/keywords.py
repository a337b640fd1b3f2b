"""Many keywords at once: one pass over a text finds whether any of them occurs, however many there are.

The keywords become automata of bounded size, which are broadcast.  A list beyond what one may take is several automata, each of
which a text passes only while none before it has hit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8 << 20  # characters of the keywords of one automaton: some hundred bytes each in memory


def _blocks(keywords: list[str], size: int) -> Iterator[list[str]]:
    held, total = [], 0
    for k in keywords:
        held.append(k)
        total += len(k)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def _automaton(keywords: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for k in keywords:
        found.add_word(k)
    found.make_automaton()
    return found


def keyword_matcher(spark: SparkSession, keywords: list[str], block: int = BLOCK) -> Callable[[Column], Column]:
    """A column function: whether any of ``keywords`` occurs in a text as it is spelt; null for a null text.

    The empty keyword occurs in every text, and an empty list in none.
    """
    words = sorted(set(keywords))
    if words[:1] == [""] or not words:
        return lambda text: F.when(text.isNotNull(), F.lit(bool(words)))
    held = [spark.sparkContext.broadcast(_automaton(part)) for part in _blocks(words, block)]

    @F.pandas_udf(T.BooleanType())
    def hit(texts: pd.Series) -> pd.Series:
        automata = [h.value for h in held]
        return texts.map(lambda t: None if t is None else any(next(a.iter(t), None) is not None for a in automata)).astype(object)

    return hit
