from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolake.llm import chat, warc

PAGES = "page_id long, url string, html string, payload_digest string, n long"


def digest(html: str | None) -> str:
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute_force(rows, least=0):
    first: dict = {}
    for page_id, _, html, *_ in rows:
        if page_id is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    out = []
    for page_id, _, html, *_ in rows:
        original = first.get(html or "")
        revisit = original is not None and page_id != original and sum((r[2] or "") == (html or "") for r in rows) > 1
        out.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a b/\n", "<p>é</p>", "clash", 1),
    (3, "http://b", "<p>é</p>", None, 1),
    (9, None, None, "x", 1),
    (-4, "http://c", "", "x", 1),
    (7, "http://d", "x" * 300_000 + "\r\n\r\nWARC/1.1\r\n", "x", 1),
    (8, "http://e", "line\n\nWARC/1.1\r\n\r\n", "x", 1),
    (3, "http://b", "<p>é</p>", None, 1),
    (None, "http://f", "<p>é</p>", None, 1),
    (None, "http://f", "alone", None, 1),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
@pytest.mark.parametrize("least", [0, 8])
def test_revisits(spark, compression, least):
    got = warc.resolve(spark.createDataFrame(ROWS, PAGES), compression=compression, least_bytes=least)
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()]
    assert sorted(rows, key=str) == brute_force(ROWS, least)


def test_hot_payload(spark):
    rows = [(i, "u", "same" if i % 3 else f"other {i}", "", 0) for i in range(600)]
    got = warc.resolve(spark.createDataFrame(rows, PAGES))
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute_force(rows)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_are_bounded_by_bytes(spark, tmp_path, compression):
    rows = [(i, f"http://{i}", f"<p>{i}</p>" * (30_000 if i % 10 else 3), "", 0) for i in range(60)]
    rows += [(100, "http://big", "y" * (17 << 20), "", 0), (101, "http://big", "y" * (17 << 20), "", 0), (102, "http://end", "z", "", 0)]
    df = spark.createDataFrame(rows, PAGES).coalesce(2)
    path = tmp_path / "w"
    warc.write_archives(df, str(path), compression=compression, archive_bytes=1 << 20)
    sizes = []
    for p in path.glob("part-*"):
        raw = p.read_bytes()
        whole = gzip.decompress(raw) if compression == "gzip" else raw
        sizes.append((len(whole), whole.count(b"WARC/1.1\r\n")))
        if compression == "gzip":  # each record is a member
            members = 0
            while raw:
                d = zlib.decompressobj(31)
                members += bool(d.decompress(raw))
                raw = d.unused_data
            assert members == sizes[-1][1]
    assert len(sizes) > 5 and all(size <= 1 << 20 or n == 1 for size, n in sizes)
    assert sorted([tuple(r)[:5] for r in warc.read_archives(spark, str(path)).collect()], key=str) == brute_force(rows)


def test_dates_are_of_the_writing(spark, tmp_path):
    before = datetime.datetime.now(datetime.UTC).replace(microsecond=0)
    warc.write_archives(spark.createDataFrame(ROWS[:1], PAGES), str(tmp_path / "w"), compression="none")
    (record,) = [r for p in (tmp_path / "w").glob("part-*") for r in warc.parse(io.BytesIO(p.read_bytes()))]
    assert before <= datetime.datetime.fromisoformat(record.headers["warc-date"]) <= datetime.datetime.now(datetime.UTC)


def test_one_id_with_several_payloads(spark):
    rows = [(1, "a", "x", "", 0), (1, "a", "y", "", 0), (2, "b", "y", "", 0), (2, "b", "x", "", 0), (0, "c", "z", "", 0)]
    got = warc.resolve(spark.createDataFrame(rows, PAGES))
    assert sorted([tuple(r)[:5] for r in got.collect()], key=str) == brute_force(rows)


def test_no_pages(spark):
    assert warc.resolve(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_text(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(ROWS[:2], PAGES), str(tmp_path / "w"), compression="none")
    records = [r for p in (tmp_path / "w").glob("part-*") for r in warc.parse(io.BytesIO(p.read_bytes()))]
    kinds = {r.headers["warc-type"]: r for r in records}
    assert set(kinds) == {"response", "revisit"}
    assert kinds["revisit"].headers["warc-refers-to"] == kinds["response"].headers["warc-record-id"]
    assert kinds["revisit"].headers["warc-profile"] == warc.PROFILE
    assert kinds["response"].block.endswith("<p>é</p>".encode()) and b"<p>" not in kinds["revisit"].block
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x|>", "&"]), st.text(alphabet="ab&;<|im_startend>lt#10\n", max_size=40)), max_size=5))
def test_turns_round_trip(turns):
    assert list(chat.parse_turns("".join(chat.format_turn(*t) for t in turns))) == turns


CONVERSATIONS = [
    (1, 2, "assistant", "second &lt;| <|im_end|>"),
    (1, 0, "user", "hello"),
    (1, 1, "assistant", "first"),
    (1, 3, "user", "no answer"),
    (2, 0, "user", None),
    (2, 0, None, "x"),
    (None, None, "assistant", ""),
    (3, 0, "assistant", "y" * 100_000),
    (3, 1, "assistant", "same"),
    (3, 1, "assistant", "same"),
]


def digests(rows):
    groups: dict = {}
    for conv, turn, role, text in sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        groups.setdefault(conv, []).append((role, text))
    out = []
    for conv, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        ends = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        ends += [len(turns) - 1] if not ends or ends[-1] != len(turns) - 1 else []
        total = sum(len("".join(chat.format_turn(*t) for t in turns[: e + 1])) for e in ends)
        out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), total))
    return sorted(out, key=str)


@pytest.mark.parametrize("base", [chat.BASE, 40])
def test_prefix_targets(spark, base):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.expand(df, base)
    assert sorted([tuple(r) for r in chat.read_back(examples).collect()], key=str) == digests(CONVERSATIONS)
    rows = examples.collect()
    full = {}
    for r in rows:
        if r["example"] is not None:
            before = "".join(p["text"] for p in sorted((p for p in rows if p["conv_id"] == r["conv_id"] and p["base"] is not None), key=lambda p: p["base"]))[: r["base_chars"]]
            full[r["conv_id"], r["example"]] = (before + r["text"], r)
    (first, _), (text, one) = full[1, 0], full[1, 1]
    assert text.startswith(first) and one["trainable"] and not one["last"] and list(chat.parse_turns(text)) == [("user", "hello"), ("assistant", "first"), ("assistant", "second &lt;| <|im_end|>")]
    assert chat.unescape(text[one["loss_start"] : one["loss_end"]]) == "second &lt;| <|im_end|>"
    closing = full[1, 2][1]
    assert not closing["trainable"] and closing["last"] and closing["loss_start"] == closing["loss_end"]
    assert sum(r["last"] for r in rows) == len({c for c, *_ in CONVERSATIONS})


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(600)] + [(2, t, "user", "x" * 50) for t in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for base in (chat.BASE, 1000):
        assert sorted(tuple(r) for r in chat.write_and_read(df, base).collect()) == digests(rows)
    written = [len(r["text"]) for r in chat.expand(df, 1000).collect()]
    assert max(written) < 1100 and sum(written) < 400 * 1100  # bases bound what an example repeats


def test_no_conversations(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string, example int"))).count() == 0
