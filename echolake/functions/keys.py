"""Cache keys, namespaces and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMESPACE_PREFIX = r"^ns[0-9a-f]{16}:"
MAX_ID = 1 << 40


def cache_key(namespace: Column, number: Column) -> Column:
    """``[ns:]msg:N``."""
    return F.concat_ws(":", F.nullif(namespace, F.lit("")), F.concat(F.lit("msg:"), number.cast("string")))


def lookup_key(namespace: Column, message: Column) -> Column:
    """``[ns:]message``, the key of an exact lookup."""
    return F.concat_ws(":", F.nullif(namespace, F.lit("")), message)


def message_id(key: Column) -> Column:
    """N of ``msg:N``; null for any other shape or a number of 2^40 and more."""
    n = F.nullif(F.regexp_extract(key, r"(?:^|:)msg:([0-9]+)$", 1), F.lit("")).try_cast("bigint")
    return F.when(n < MAX_ID, n)


def strip_namespace(source: Column) -> Column:
    return F.regexp_replace(source, NAMESPACE_PREFIX, "")


def in_namespace(key: Column, namespace: Column) -> Column:
    """The one-sided test of retrieval: without a namespace every key will do."""
    return (F.coalesce(namespace, F.lit("")) == "") | F.startswith(key, F.concat(namespace, F.lit(":")))


def same_namespace(key: Column, namespace: Column) -> Column:
    """The symmetric test of merging: without a namespace the key must not have one either."""
    return F.when(F.coalesce(namespace, F.lit("")) == "", ~key.rlike(NAMESPACE_PREFIX)).otherwise(F.startswith(key, F.concat(namespace, F.lit(":"))))


def variant_id(tokenizer: Column, lower: Column, pooling: Column) -> Column:
    return F.concat(tokenizer, F.lit("|lower="), lower.cast("int").cast("string"), F.lit("|pooling="), pooling)


def fingerprint(model: Column, vocab: Column, dim: Column, tokenizer: Column) -> Column:
    return F.concat(F.lit("model="), model, F.lit(";vocab="), vocab, F.lit(";dim="), dim.cast("string"), F.lit(";tok="), tokenizer)


def fingerprint_differs(expected: Column, found: Column) -> Column:
    """Whether vectors of a file must be dropped: one is expected, and the file has none or another."""
    e, f = F.coalesce(expected, F.lit("")), F.coalesce(found, F.lit(""))
    return (e != "") & (e != f)
