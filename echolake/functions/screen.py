"""Screening of texts: injection phrases, URLs, keywords and byte limits, as column expressions."""

from __future__ import annotations

import functools
import re
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases that mark an injection, what a URL looks like, and the reasons that are given.
INJECTION_PHRASES = (
    "ignore previous",
    "ignore all instructions",
    "ignore the above",
    "disregard previous",
    "disregard all prior",
    "forget your prompt",
    "forget all previous",
    "reveal your system prompt",
    "print your system prompt",
    "repeat your system prompt",
    "override your instructions",
    "[/INST]",
    "<|im_start|>",
    "<|system|>",
    "DAN mode",
    "jailbreak",
)
URL_PATTERN = r"""(?i)(https?://|ftp://|www\.)[^\s<>"']+"""

REASONS = {
    "injection": "Request rejected: potential injection detected",
    "url_in": "Request rejected: URLs are not allowed",
    "keyword": "Request rejected: blocked content",
    "url_out": "Response rejected: contains URL",
}

_INJECTION = "(?i)" + "|".join(re.sub(r"([\[\]|/<>])", r"\\\1", p) for p in INJECTION_PHRASES)


def contains_injection(text: Column) -> Column:
    """Whether any of the fixed phrases occurs, in any case of A-Z.

    Byte searches in the lower-cased text, made once, settle nearly all rows; only where one hits does the alternation,
    which backtracks at every place, confirm it (lower-casing also maps a few letters outside ASCII to a-z).
    """
    any_phrase = F.transform(F.array(F.lower(text)), lambda t: functools.reduce(or_, [t.contains(p.lower()) for p in INJECTION_PHRASES]))
    return F.element_at(any_phrase, 1) & text.rlike(_INJECTION)


def contains_url(text: Column) -> Column:
    return text.rlike(URL_PATTERN)


def contains_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs as it is spelt."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | text.contains(k)
    return hit


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def truncate_bytes(text: Column, limit: int) -> Column:
    """The first ``limit`` bytes, as binary: the cut may fall inside a character."""
    return F.substring(F.encode(text, "UTF-8"), 1, limit)


def truncate_text(text: Column, limit: int) -> Column:
    """As :func:`truncate_bytes`, with a cut last character replaced so that the result is valid text."""
    return F.make_valid_utf8(truncate_bytes(text, limit).cast("string"))


def _result(action: str, reason: Column, sanitized: Column) -> Column:
    return F.struct(F.lit(action).alias("action"), reason.alias("reason"), sanitized.alias("sanitized"))


def _none() -> Column:
    return F.lit(None).cast("string")


def screen_input(text: Column, *, block_urls: bool = False, keywords: list[str] = (), max_bytes: int = 0) -> Column:
    """``struct<action, reason, sanitized>``; the first rule that applies decides: injection, URL, keyword, length."""
    t = F.coalesce(text, F.lit(""))
    out = F.when(contains_injection(t), _result("reject", F.lit(REASONS["injection"]), _none()))
    if block_urls:
        out = out.when(contains_url(t), _result("reject", F.lit(REASONS["url_in"]), _none()))
    if keywords:
        out = out.when(contains_keyword(t, list(keywords)), _result("reject", F.lit(REASONS["keyword"]), _none()))
    if max_bytes > 0:
        out = out.when(byte_length(t) > max_bytes, _result("truncate", _none(), truncate_text(t, max_bytes)))
    return out.otherwise(_result("pass", _none(), t))


def screen_output(text: Column, *, block_urls: bool = False, max_bytes: int = 0) -> Column:
    """As :func:`screen_input`, with the URL and the length rule only."""
    t = F.coalesce(text, F.lit(""))
    rules = []
    if block_urls:
        rules.append((contains_url(t), _result("reject", F.lit(REASONS["url_out"]), _none())))
    if max_bytes > 0:
        rules.append((byte_length(t) > max_bytes, _result("truncate", _none(), truncate_text(t, max_bytes))))
    passed = _result("pass", _none(), t)
    if not rules:
        return passed
    out = F.when(*rules[0])
    for r in rules[1:]:
        out = out.when(*r)
    return out.otherwise(passed)


def looks_suspicious(text: Column) -> Column:
    """Whether a fragment could be a part of a URL."""
    return text.contains("http") | text.contains("www.") | text.contains("ftp")
