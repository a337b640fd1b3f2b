"""Chat requests: JSON bodies parsed once into VARIANT, then projected.

Nothing here fails on bad input: a body that is no JSON, or fields of other types, give empty texts and false flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolake.functions.hashing import fnv1a_hex


def parse_body(body: Column) -> Column:
    return F.try_parse_json(body)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _string(v: Column, path: str) -> Column:
    """The string at ``path``; null where there is none or another type."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(_kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def _is_object(v: Column) -> Column:
    return F.startswith(_kind(v), F.lit("OBJECT"))


def messages(body: Column) -> Column:
    """The messages as an array of VARIANT; empty where the body has none."""
    return F.coalesce(F.try_variant_get(body, "$.messages", "array<variant>"), F.array().cast("array<variant>"))


def message_role(message: Column) -> Column:
    return F.coalesce(_string(message, "$.role"), F.lit(""))


def message_text(message: Column) -> Column:
    """The text of a message: a string as it is, of an array its strings and the ``text`` of its objects, joined."""
    parts = F.coalesce(F.try_variant_get(message, "$.content", "array<variant>"), F.array().cast("array<variant>"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.when(_kind(p) == "STRING", F.try_variant_get(p, "$", "string")), _string(p, "$.text"), F.lit(""))), "")
    is_array = F.startswith(_kind(F.try_variant_get(message, "$.content", "variant")), F.lit("ARRAY"))
    return F.coalesce(_string(message, "$.content"), F.when(is_array, joined), F.lit(""))


def turns(body: Column) -> Column:
    """``array<struct<role, text>>`` of the messages that are objects."""
    kept = F.filter(messages(body), _is_object)
    return F.transform(kept, lambda m: F.struct(message_role(m).alias("role"), message_text(m).alias("text")))


def _joined(turn: Column) -> Column:
    return F.array_join(F.filter(F.transform(turn, lambda t: t["text"]), lambda x: x != ""), "\n")


def namespace_of_text(system: Column) -> Column:
    """The namespace of joined system texts; empty for none."""
    return F.when(F.coalesce(system, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("ns"), fnv1a_hex(system)))


def namespace(turn: Column) -> Column:
    """``ns`` and the hash of the system texts in order, joined by line ends; empty where there is none."""
    return namespace_of_text(_joined(F.filter(turn, lambda t: t["role"] == "system")))


def last_user_text(turn: Column) -> Column:
    """The text of the last user turn, also where it is empty; empty where there is no such turn."""
    users = F.filter(turn, lambda t: t["role"] == "user")
    return F.coalesce(F.try_element_at(users, F.lit(-1))["text"], F.lit(""))


def all_text(turn: Column) -> Column:
    """What input screening looks at: all texts that are not empty, joined by line ends."""
    return _joined(turn)


def _true(body: Column, path: str) -> Column:
    at = F.try_variant_get(body, path, "variant")
    return F.coalesce((_kind(at) == "BOOLEAN") & F.try_variant_get(body, path, "boolean"), F.lit(False))


def wants_stream(body: Column) -> Column:
    return _true(body, "$.stream")


def includes_usage(body: Column) -> Column:
    return _true(body, "$.stream_options.include_usage")


def _has(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def is_tool_request(body: Column) -> Column:
    """Definitions of tools or functions, a message of such a role, or a call in a message."""
    tool = F.exists(messages(body), lambda m: message_role(m).isin("tool", "function") | _has(m, "tool_calls") | _has(m, "function_call"))
    return F.coalesce(_has(body, "tools") | _has(body, "functions") | tool, F.lit(False))


def annotate_status(body: Column, status: Column) -> Column:
    """The body with ``_cache`` added where it is a JSON object, else the body itself."""
    parsed = F.try_parse_json(body)
    inner = F.regexp_replace(F.trim(body), r"\}\s*$", "")
    comma = F.when(inner.rlike(r"^\{\s*$"), F.lit("")).otherwise(F.lit(","))
    return F.when(_is_object(parsed), F.concat(inner, comma, F.lit('"_cache":"'), status, F.lit('"}'))).otherwise(body)


def upstream_status(status: Column, timed_out: Column | None = None) -> Column:
    """What a caller is told: the upstream's status where there is one, else 504 for a timeout and 502 for any other failure."""
    failed = F.lit(502) if timed_out is None else F.when(F.coalesce(timed_out, F.lit(False)), 504).otherwise(502)
    return F.when(status > 0, status).otherwise(failed)


def passes_through(status: Column, content_type: Column) -> Column:
    """Whether a reply is relayed piece by piece: only an event stream of a 2xx status is, all else is held as a whole."""
    return F.coalesce(status.between(200, 299) & F.lower(content_type).contains("text/event-stream"), F.lit(False))


def classify(requests: DataFrame, body: str = "body") -> DataFrame:
    """``requests`` with all that routing needs, from one parse of each body."""
    parsed = requests.withColumn("_body", parse_body(F.col(body))).withColumn("_turns", turns(F.col("_body")))
    t, b = F.col("_turns"), F.col("_body")
    return parsed.withColumns(
        {
            "namespace": namespace(t),
            "user_text": last_user_text(t),
            "all_text": all_text(t),
            "is_stream": wants_stream(b),
            "include_usage": includes_usage(b),
            "is_tool": is_tool_request(b),
        }
    ).drop("_body", "_turns")


def cacheable(enabled: Column, is_tool: Column, user_text: Column) -> Column:
    return enabled & ~is_tool & (user_text != "")
