"""Vectors as arrays of floats; all arithmetic in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPSILON = 1e-8  # added to the product of norms


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [-1, 1]; null where lengths differ."""
    c = dot(a, b) / (norm(a) * norm(b) + F.lit(EPSILON))
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


def normalise(a: Column) -> Column:
    # a one-element transform, so that the norm is computed once and not for every number
    return F.transform(F.array(norm(a) + F.lit(1e-12)), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cls_pool(hidden: Column) -> Column:
    """The vector of the first token."""
    return F.element_at(hidden, 1)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """The mean over tokens whose mask is 1; null where there is none."""
    kept = F.filter(F.arrays_zip(hidden.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    first = F.transform(F.element_at(hidden, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, first, lambda s, t: F.zip_with(s, t["v"], lambda x, y: x + y.cast("double")))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))


@F.pandas_udf(T.DoubleType())
def cosine_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`cosine` in Arrow batches, for volume: higher-order functions are interpreted element by element."""
    out = np.full(len(a), np.nan)
    sizes = np.array([-1 if x is None or y is None or len(x) != len(y) else len(x) for x, y in zip(a, b)])
    for n in set(sizes.tolist()) - {-1}:
        at = np.flatnonzero(sizes == n)
        x, y = (np.stack(s.iloc[at].to_list()).astype(np.float64) if n else np.zeros((len(at), 0)) for s in (a, b))
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)) + EPSILON
        out[at] = np.clip((x * y).sum(1) / norms, -1, 1)
    return pd.Series(out).astype(object).where(sizes >= 0, None)


@F.pandas_udf(T.StringType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Base64 of the little-endian 32-bit floats."""
    import base64

    return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, dtype="<f4").tobytes()).decode())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(text: pd.Series, dim: pd.Series) -> pd.Series:
    """The vector, empty where the text is not base64 or does not hold ``dim`` floats."""
    import base64
    import binascii

    def one(t, n):
        if t is None:
            return None
        try:
            raw = base64.b64decode(t, validate=True)
        except (binascii.Error, ValueError):
            return []
        return np.frombuffer(raw, dtype="<f4").tolist() if len(raw) == 4 * n else []

    return pd.Series([one(t, n) for t, n in zip(text, dim)])
