"""Screening of event streams, in batch over ordered chunks and online with state per stream.

Both forms run the same :class:`Screen`, so they agree whatever the chunks: events are framed at blank lines, each is
screened, then the last 512 bytes of text together with its own text if either looks like a part of a URL.  A
rejected event and all after it are dropped.  Once the accepted bytes reach a cap, an end mark is sent and the rest
is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from echolake.functions.screen import URL_PATTERN
from echolake.functions.sse import BOUNDARY, DONE_EVENT, LINE_LIMIT

WINDOW_BYTES = 512
_URL = re.compile(URL_PATTERN)
_BOUNDARY = re.compile(BOUNDARY)
_PROMPT, _COMPLETION = (re.compile(f'"{k}"\\s*:\\s*(-?[0-9]+)') for k in ("prompt_tokens", "completion_tokens"))


def event_text(event: str) -> str:
    """The content of an event's choices; empty for an end mark, bad JSON or content that is no string."""
    lines = [x.removesuffix("\r")[5:] for x in event.split("\n") if x.startswith("data:")]
    try:
        body = json.loads("\n".join(x.removeprefix(" ") for x in lines))
        choices = body["choices"]
        out = []
        for c in choices if isinstance(choices, list) else []:
            holder = c.get("delta") if isinstance(c.get("delta"), dict) else c.get("message")
            text = holder.get("content") if isinstance(holder, dict) else None
            out.append(text if isinstance(text, str) else "")
        return "".join(out)
    except (ValueError, KeyError, TypeError, AttributeError):
        return ""


def _suspicious(text: str) -> bool:
    return "http" in text or "www." in text or "ftp" in text


@dataclass
class Screen:
    """The state of one stream."""

    pending: str = ""
    window: str = ""
    accepted: int = 0
    rejected: bool = False
    truncated: bool = False
    events: int = 0
    block_urls: bool = field(default=True)
    cap: int = field(default=0)
    searched: int = 0  # of pending: no event ends before

    def _rejects(self, event: str) -> bool:
        if self.block_urls and _URL.search(event):
            return True
        text = event_text(event)
        if self.block_urls and (_suspicious(text) or _suspicious(self.window)) and _URL.search(self.window + text):
            return True
        self.window = (self.window + text).encode()[-WINDOW_BYTES:].decode(errors="ignore")
        return False

    def feed(self, chunk: str, final: bool = False) -> str:
        """What may be passed on after ``chunk``."""
        out: list[str] = []
        if self.rejected or self.truncated:
            return ""
        self.pending += chunk
        while m := _BOUNDARY.search(self.pending, self.searched):
            if m.end() == len(self.pending) and not final:
                if self.pending.endswith("\r"):  # a line feed may belong to it
                    break
            event, whole, self.searched = self.pending[: m.start()], self.pending[: m.end()], 0
            if self._rejects(event):
                self.rejected, self.pending = True, ""
                return "".join(out)
            self.pending = self.pending[m.end() :]
            self.events += 1
            self.accepted += len(whole.encode())
            out.append(whole)
            if self.cap > 0 and self.accepted >= self.cap:
                self.truncated, self.pending = True, ""
                return "".join([*out, DONE_EVENT])
        self.searched = len(self.pending.rstrip("\r\n"))  # an end may have begun with what follows
        if final and self.pending:
            if self._rejects(self.pending):
                self.rejected = True
            else:
                out.append(self.pending)
                self.events += 1
                self.accepted += len(self.pending.encode())
            self.pending = ""
        return "".join(out)


@dataclass
class Usage:
    """Token counts and the end mark of one stream, from chunks that may be cut anywhere.

    What is carried from chunk to chunk is bounded: a line without its end, of at most LINE_LIMIT bytes, and a few
    characters in which an end mark may have begun.
    """

    line: str = ""
    skipping: bool = False  # the line at hand is too long
    tail: str = ""
    prompt_tokens: int = 0
    completion_tokens: int = 0
    seen: bool = False
    done: bool = False

    def feed(self, chunk: str) -> None:
        self.done = self.done or "[DONE]" in self.tail + chunk
        self.tail = (self.tail + chunk)[-5:]
        *whole, rest = chunk.split("\n")
        for x in whole:
            if not self.skipping:
                self._line(self.line + x)
            self.line, self.skipping = "", False
        if not self.skipping:
            self.line += rest
            if len(self.line.encode()) > LINE_LIMIT + 1:  # with a carriage return
                self.line, self.skipping = "", True

    def _line(self, line: str) -> None:
        line = line.removesuffix("\r")
        if not line.startswith("data:") or '"usage"' not in line or len(line.encode()) > LINE_LIMIT:
            return
        for name, found in (("prompt_tokens", _PROMPT.search(line)), ("completion_tokens", _COMPLETION.search(line))):
            if found and -(1 << 63) <= (n := int(found[1])) < 1 << 63:
                setattr(self, name, n)
                self.seen = True


_USAGE = "stream_id string, prompt_tokens long, completion_tokens long, seen boolean, done boolean"


def usage_batch(chunks: DataFrame) -> DataFrame:
    """One row per stream of ``chunks`` (stream_id, seq, chunk), which are streamed in order: its usage and whether it ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in _USAGE.split(", ")], [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        last, u = None, None
        for b in batches:
            rows = []
            for stream, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if u is None or stream != last:
                    if u is not None:
                        rows.append((last, u.prompt_tokens, u.completion_tokens, u.seen, u.done))
                    last, u = stream, Usage()
                u.feed(chunk or "")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if u is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((last, u.prompt_tokens, u.completion_tokens, u.seen, u.done), types)], names=names)

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("string").alias("chunk"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, _USAGE)


def usage_stream(chunks: DataFrame) -> DataFrame:
    """As :func:`usage_batch` for a streaming frame: what is known of a stream after each micro-batch; its state goes when it ends."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        u = Usage(*state.get) if state.exists else Usage()
        for chunk in pd.concat(list(frames)).sort_values("seq", kind="stable")["chunk"]:
            u.feed(chunk or "")
        if u.done:
            state.remove()
        else:
            state.update(tuple(asdict(u).values()))
        yield pd.DataFrame({"stream_id": [key[0]], "prompt_tokens": [u.prompt_tokens], "completion_tokens": [u.completion_tokens], "seen": [u.seen], "done": [u.done]})

    held = "line string, skipping boolean, tail string, prompt_tokens long, completion_tokens long, seen boolean, done boolean"
    return chunks.groupBy("stream_id").applyInPandasWithState(run, _USAGE, held, "append", GroupStateTimeout.NoTimeout)


_SCREEN = "pending string, window string, accepted long, rejected boolean, truncated boolean, events int, block_urls boolean, cap long, searched int"
_OUT = "stream_id string, passed string, events int, accepted_bytes long, rejected boolean, truncated boolean"


def screen_batch(chunks: DataFrame, block_urls: bool = True, cap: int = 0) -> DataFrame:
    """One row per stream of ``chunks`` (stream_id, seq, chunk), which are streamed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _OUT.split(", ")]
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_()]
        last, s, parts = None, None, []

        def row():
            parts.append(s.feed("", final=True))
            return last, "".join(parts), s.events, s.accepted, s.rejected, s.truncated

        for b in batches:
            rows = []
            for stream, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if s is None or stream != last:
                    if s is not None:
                        rows.append(row())
                    last, s, parts = stream, Screen(block_urls=block_urls, cap=cap), []
                parts.append(s.feed(chunk or ""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if s is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), types)], names=names)

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), F.col("chunk").cast("string").alias("chunk"))
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", "seq").mapInArrow(run, _OUT)


def screen_stream(chunks: DataFrame, block_urls: bool = True, cap: int = 0, idle_ms: int = 0) -> DataFrame:
    """As :func:`screen_batch` for a streaming frame, which also has ``final``; a row for every micro-batch of a stream.

    ``idle_ms`` ends a stream that is silent for so long; it counts as aborted and its state is dropped.
    """
    schema = "stream_id string, passed string, events int, accepted_bytes long, rejected boolean, truncated boolean, ended boolean, idle boolean"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Screen(*state.get) if state.exists else Screen(block_urls=block_urls, cap=cap)
        idle = state.hasTimedOut
        out, ended = "", idle
        if not idle:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
            for chunk, final in zip(rows["chunk"], rows["final"]):
                out += s.feed(chunk or "", bool(final))
                ended = ended or bool(final)
        if ended:
            state.remove()
        else:
            state.update(tuple(asdict(s).values()))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"stream_id": [key[0]], "passed": [out], "events": [s.events], "accepted_bytes": [s.accepted], "rejected": [s.rejected], "truncated": [s.truncated], "ended": [ended], "idle": [idle]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy("stream_id").applyInPandasWithState(run, schema, _SCREEN, "append", timeout)


def idle_gaps(chunks: DataFrame, limit_seconds: float) -> DataFrame:
    """Streams of a batch with a gap between chunks above the limit; ``ts`` orders them."""
    from pyspark.sql import Window

    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(Window.partitionBy("stream_id").orderBy("ts", "seq")))
    return chunks.withColumn("_gap", gap).groupBy("stream_id").agg((F.coalesce(F.max("_gap"), F.lit(0)) / 1e6).alias("longest_gap"), F.coalesce(F.max("_gap") > limit_seconds * 1e6, F.lit(False)).alias("idle_abort"))


def stream_stats(chunks: DataFrame, started: DataFrame, limit_bytes: int) -> DataFrame:
    """Per stream the time to the first chunk in milliseconds, bytes, and whether capturing overflows."""
    got = chunks.groupBy("stream_id").agg(F.min("ts").alias("_first"), F.sum(F.octet_length("chunk")).alias("bytes"))
    both = started.join(got, "stream_id", "left")
    return both.select("stream_id", ((F.unix_micros("_first") - F.unix_micros("started")) / 1000).alias("ttft_ms"), F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.coalesce("bytes", F.lit(0)) > limit_bytes).alias("overflow"))
