"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is trainable.
Turns after the last assistant turn form a closing example without a trainable part, so that no turn is lost.

An example is written as its full text, context and all, with the place of its loss mask there.  The full texts of a
conversation's examples are prefixes of one another and together grow with the square of its length.  So that a very long
conversation stays bearable, whole turns that fill ``BASE`` characters become a base: a row of its own, written once, and
the examples that follow begin behind it (``base_chars``; 0 for all examples of conversations under ``BASE``).  The full text of
an example is the conversation's bases up to ``base_chars`` and then its ``text``.  A task holds a conversation's last base at
most and the turn at hand; turns are sorted within their partition and streamed.

The template is ``<|im_start|>role\\n text <|im_end|>\\n`` without the blanks.  In texts and roles ``&`` becomes ``&amp;`` and
``<|`` becomes ``&lt;|``, and in roles a line end becomes ``&#10;``; no control string can then arise from them, and
undoing it gives them back exactly.

Defined cases: a null text or role is the empty one; rows of equal conversation and turn are ordered by role and text;
null turns come first; rows without a conversation form one; a conversation without an assistant is one closing example;
a turn of any length is whole in one row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolake.llm.base import delete, fresh_path, materialize, slices, tidy

START, END = "<|im_start|>", "<|im_end|>"
BASE = 1 << 20  # characters


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<|", "&lt;|")


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role).replace(chr(10), '&#10;')}\n{escape(text)}{END}\n"


def parse_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn in ``formatted``."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END + "\n", line)
        if not formatted.startswith(START, at):
            raise ValueError("a turn does not begin with its mark")
        yield unescape(formatted[at + len(START) : line].replace("&#10;", "\n")), unescape(formatted[line + 1 : end])
        at = end + len(END) + 1


_EXAMPLES = "conv_id long, example int, base int, base_chars long, text string, loss_start long, loss_end long, trainable boolean, last boolean"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: int = 2048, chars: int = 8 << 20, text: int | None = None) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[text]) if text is not None else 0
        if len(held) == size or n > chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def expand(conversations: DataFrame, base: int = BASE) -> DataFrame:
    """The examples of all conversations, and their bases (rows with ``base``, a number, in place of ``example``); ``loss_start`` and
    ``loss_end`` are places in an example's full text, of which ``text`` is what follows ``base_chars``."""

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begun, conv, number, bases, before = False, None, 0, 0, 0
        turns: list[str] = []  # since the last base
        waiting = None  # the last example, until it is known whether another follows
        closing = False  # turns after it

        def ended() -> Iterator[tuple]:
            if waiting and not closing:
                yield (*waiting, True)
            else:
                if waiting:
                    yield (*waiting, False)
                yield conv, number, None, before, "".join(turns), 0, 0, False, True

        for b in slices(batches):
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if not begun or c != conv:
                    if begun:
                        yield from ended()
                    begun, conv, number, bases, before, turns, size, waiting, closing = True, c, 0, 0, 0, [], 0, None, False
                if size >= base:
                    yield conv, None, bases, before, "".join(turns), 0, 0, False, False
                    bases, before, turns, size = bases + 1, before + size, [], 0
                turns.append(format_turn(role, text))
                size += len(turns[-1])
                closing = role != "assistant"
                if not closing:
                    if waiting:
                        yield (*waiting, False)
                    end = before + size - len(END) - 1
                    waiting = (conv, number, None, before, "".join(turns), end - len(escape(text)), end, True)
                    number += 1
        if begun:
            yield from ended()

    names = [x.split()[0] for x in _EXAMPLES.split(", ")]
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(tidy(lambda it: _batches(examples(it), _TYPES, names, text=4)), _EXAMPLES)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = "conv_id long, number int, chars long, loss string, turns string"


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: all turns, the text under the loss masks, and the total length of the full texts.

    Each example is read where it is stored; only the text under its mask and, of a conversation's last example and of
    its bases, the turns go on to where the conversation's digests are made, so that a turn goes there twice at most.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches):
            for conv, number, base, before, text, lo, hi, trainable, last in zip(*[b.column(k).to_pylist() for k in range(4)], b.column(4), *[b.column(k).to_pylist() for k in range(5, 9)]):
                whole = text.as_py()
                if base is not None:  # bases come before examples
                    yield conv, base - (1 << 31), 0, "", whole
                else:
                    yield conv, number, before + len(whole), unescape(whole[lo - before : hi - before]) if trainable else "", whole if last else None

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        begun, conv = False, None
        for b in slices(batches):
            for c, _, length, target, held in zip(*[col.to_pylist() for col in b.columns]):
                if not begun or c != conv:
                    if begun:
                        yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total
                    begun, conv, n, chars, total = True, c, 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                total += length
                chars += len(target)
                loss.update(target.encode())
                for role, text in parse_turns(held or ""):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
        if begun:
            yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), total

    one, one_names = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()], [x.split()[0] for x in _READ.split(", ")]
    two, two_names = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], [x.split()[0] for x in _DIGEST.split(", ")]
    parts = examples.mapInArrow(tidy(lambda it: _batches(read(it), one, one_names, text=3)), _READ)
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "number")
    return ordered.mapInArrow(tidy(lambda it: _batches(digests(it), two, two_names)), _DIGEST)


def write_and_read(conversations: DataFrame, base: int = BASE) -> DataFrame:
    """:func:`read_back` of the examples as they were written; these go again."""
    spark = conversations.sparkSession
    path = fresh_path(spark, "chat-examples")
    made = expand(conversations, base)
    # examples repeat their context, which a wide window compresses
    made.write.option("compression", "zstd").parquet(path)
    got = materialize(read_back(spark.read.schema(made.schema).parquet(path)), "chat-read")
    delete(spark, path)
    return got
