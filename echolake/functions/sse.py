"""Server-sent events in batch form: a stream's text as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = r"(?>\r\n|\n|\r){2,}"  # a line end of two characters counts once
DONE_EVENT = "data: [DONE]\n\n"
HIT_COMMENT = ": cache hit\n\n"
CAPTURE_LIMIT = 2 << 20
LINE_LIMIT = 16_384


def events(text: Column) -> Column:
    """The events of a whole stream; what follows the last boundary counts as one."""
    return F.filter(F.split(text, BOUNDARY), lambda e: e != "")


def payload(event: Column) -> Column:
    """The ``data:`` lines of an event, joined by line ends."""
    lines = F.transform(F.split(event, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    data = F.filter(lines, lambda x: F.startswith(x, F.lit("data:")))
    return F.array_join(F.transform(data, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")


def _text_of(choice: Column) -> Column:
    def string(path: str) -> Column:
        at = F.try_variant_get(choice, path, "variant")
        return F.when(F.coalesce(F.schema_of_variant(at), F.lit("")) == "STRING", F.try_variant_get(choice, path, "string"))

    has_delta = F.startswith(F.coalesce(F.schema_of_variant(F.try_variant_get(choice, "$.delta", "variant")), F.lit("")), F.lit("OBJECT"))
    return F.coalesce(F.when(has_delta, string("$.delta.content")).otherwise(string("$.message.content")), F.lit(""))


def event_text(event: Column) -> Column:
    """The content of one event's choices; empty for ``[DONE]``, bad JSON or content that is no string."""
    choices = F.try_variant_get(F.try_parse_json(payload(event)), "$.choices", "array<variant>")
    return F.coalesce(F.array_join(F.transform(choices, _text_of), ""), F.lit(""))


def content(text: Column) -> Column:
    """The content of a whole stream."""
    return F.array_join(F.transform(events(text), event_text), "")


def has_done(text: Column) -> Column:
    return text.contains("[DONE]")


def usage(text: Column) -> Column:
    """``struct<prompt_tokens, completion_tokens, seen>`` from whole data lines with a ``usage`` key; the last value wins.

    A line without its end, or of more than LINE_LIMIT bytes, does not count.
    """
    lines = F.split(text, "\n")
    lines = F.transform(F.slice(lines, 1, F.size(lines) - 1), lambda x: F.regexp_replace(x, "\r$", ""))
    lines = F.filter(lines, lambda x: F.octet_length(x) <= LINE_LIMIT)
    lines = F.filter(lines, lambda x: F.startswith(x, F.lit("data:")) & x.contains('"usage"'))

    def last(key: str) -> Column:
        found = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, f'"{key}"\\s*:\\s*(-?[0-9]+)', 1)), lambda x: x != "")
        return F.try_element_at(found, F.lit(-1)).try_cast("bigint")

    p, c = last("prompt_tokens"), last("completion_tokens")
    return F.struct(F.coalesce(p, F.lit(0).cast("long")).alias("prompt_tokens"), F.coalesce(c, F.lit(0).cast("long")).alias("completion_tokens"), (p.isNotNull() | c.isNotNull()).alias("seen"))


def fill_eligible(size: Column, text: Column, done: Column, aborted: Column) -> Column:
    """Whether a finished stream may fill the cache."""
    return (size <= CAPTURE_LIMIT) & (text != "") & done & ~aborted


def replay(stored: Column) -> Column:
    """What a hit sends: a comment, the stored bytes, and an end mark if they lack one."""
    return F.concat(F.lit(HIT_COMMENT), stored, F.when(has_done(stored), F.lit("")).otherwise(F.lit(DONE_EVENT)))


def abort_reason(by_filter: Column, upstream_idle: Column, deadline: Column, client: Column) -> Column:
    """The first cause that applies."""
    return F.when(by_filter, "filter").when(upstream_idle, "upstream_idle").when(deadline, "deadline").when(client, "client").otherwise("unknown")
