"""Entity tokens: numbers, acronyms and identifiers that two texts must share to count as the same question."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("numbers", "acronyms", "identifiers")


def entity_tokens(text: Column) -> Column:
    """``struct<numbers, acronyms, identifiers>`` of sorted distinct maximal ASCII alphanumeric runs.

    Digits only make a number, digits and letters an identifier, capitals only an acronym; other runs are dropped and
    everything else, non-ASCII included, separates.
    """
    t = F.coalesce(text, F.lit(""))

    def kind(run: str) -> Column:
        # possessive runs between borders: a run of another kind is passed over without backtracking
        found = F.regexp_extract_all(t, F.lit(f"(?<![A-Za-z0-9]){run}(?![A-Za-z0-9])"), F.lit(0))
        return F.array_sort(F.array_distinct(found))

    return F.struct(
        kind("[0-9]++").alias("numbers"),
        kind("[A-Z]++").alias("acronyms"),
        kind("(?:[A-Za-z]++[0-9]|[0-9]++[A-Za-z])[A-Za-z0-9]*+").alias("identifiers"),
    )


def entity_mismatch(a: Column, b: Column) -> Column:
    """Whether any of the three sets differs; the sets are sorted and distinct, so inequality is enough."""
    out = F.lit(False)
    for k in KINDS:
        out = out | (a[k] != b[k])
    return out


def entity_missing(query: Column, candidate: Column) -> Column:
    """The one-directional test: whether ``query`` has a token that ``candidate`` lacks."""
    out = F.lit(False)
    for k in KINDS:
        out = out | (F.size(F.array_except(query[k], candidate[k])) > 0)
    return out
