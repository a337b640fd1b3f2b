from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolake.llm import decontaminate, packing

TEXTS = ["", "a", "Hello, world!  two  blanks", "tabs\tand\nlines \n x", " lead", "trail ", "don't we'll", "naïve café ß ÀÉ", "你好 世界", "x y 　z", "1234 5,678.90", "<|endoftext|> inside", "a <|endoftext|>", "emoji 😀 ok", "a\r\n b", "\x1c x", "ǅ ᾳ ½ ² Ⅷ", "word " * 5000 + "end", "né̈ combining", "a\n\n\n b", "__init__ (x)"]


def full_ids(text):
    from tokenizers import Tokenizer

    t = full_ids.t = getattr(full_ids, "t", None) or Tokenizer.from_file(packing.tokenizer_path())
    return t.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizer():
    encode = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(4)
    made = ["".join(rng.choice("ab .,'s\n\té1!<|>½") for _ in range(rng.randrange(40))) for _ in range(400)]
    for text in TEXTS + made:
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == full_ids(text), text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_fit(sizes):
    x = np.array(sizes)
    bins, places, free = packing.best_fit_decreasing(x, 20)
    for b in set(bins.tolist()):
        held = sorted((p, s) for p, s, c in zip(places.tolist(), sizes, bins.tolist()) if c == b)
        assert [p for p, _ in held] == list(itertools.accumulate([0, *(s for _, s in held)]))[:-1]
        assert sum(s for _, s in held) == 20 - free[b]
    bound = packing.lower_bound(x, 20)
    best = len(sizes)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for k in range(len(loads)):
            if loads[k] + sizes[i] <= 20:
                place(i + 1, [*loads[:k], loads[k] + sizes[i], *loads[k + 1 :]])
        place(i + 1, [*loads, sizes[i]])

    place(0, [])
    assert bound <= best <= len(free)


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([11] * 10), 20) == 10
    assert packing.lower_bound(np.array([11] * 10 + [10] * 3), 20) == 12


DOCS = "doc_id long, text string, piece int, sequence_id string"


def test_pack_documents(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(900))), 0, "x") for i in range(150)]
    rows += [(500, None, 0, ""), (501, "", 0, ""), (7, rows[7][1], 0, ""), (None, "no id", 0, ""), (502, "word " * 9000, 0, "")]
    got = packing.pack_documents(spark.createDataFrame(rows, DOCS), packing.tokenizer_path(), group=60).collect()
    wanted = []
    for doc_id, text, *_ in rows:
        ids = [*full_ids(text or ""), 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        wanted += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(itertools.pairwise(cuts))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=str) == sorted(wanted, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = np.array([r["length"] for r in got])
    assert packing.lower_bound(lengths, 2048) <= len(by) <= packing.lower_bound(lengths, 2048) + 1


@pytest.mark.parametrize("n", [1, 5, 9, 40])
def test_small_inputs_share_a_sequence(spark, n):
    docs = spark.createDataFrame([(i, "three short words") for i in range(n)], "doc_id long, text string")
    assert packing.pack_documents(docs, packing.tokenizer_path()).select("sequence_id").distinct().count() == 1


@pytest.mark.parametrize("group", [50, 400, 10**6])
def test_groups_exchange_until_the_whole_is_certified(spark, group):
    rng = random.Random(2)
    rows = [(i, rng.choice([rng.randrange(1, 200), rng.randrange(1, 2049)])) for i in range(1500)]
    items = spark.createDataFrame(rows, "row long, length long")
    got = packing.pack(items, group=group).join(items, "row").collect()
    assert sorted(r["row"] for r in got) == [i for i, _ in rows]
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["place"], r["length"]))
    for held in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(held)))
        assert [p for p, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= 2048
    bound = packing.certificate(items)
    assert bound == packing.lower_bound(np.array([n for _, n in rows]), 2048) and bound <= len(by) <= bound + (4 if group == 50 else 2)


def test_pack_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), packing.tokenizer_path()).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(docs, items, size=13):
    out = []
    for doc_id, text in docs:
        ws = WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(ws), set()
        for item, t in items:
            seq = WORD.findall((t or "").translate(LOWER))
            n = min(size, len(seq))
            for j in range(len(seq) - n + 1 if n else 0):
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == seq[j : j + n]:
                        hit[i : i + n] = [True] * n
                        found.add(item)
        h = sum(hit)
        out.append((doc_id, len(ws), h, len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), h > 0 and 20 * h >= len(ws)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(8)
    word = lambda: rng.choice(["Foo", "bar", "baz-9", "qux", "É", "zap", "a_b"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 13, 14, 30])))) for i in range(12)] + [(3, "again, this item"), (50, None), (51, "!!!")]
    items = [(i, t) for i, t in items if t is None or len(t.split()) != 1]
    docs = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(40)]
    docs += [(100 + i, f"one two {t or ''} three " + "filler " * rng.choice([0, 50, 400])) for i, t in items]
    docs += [(900, None), (901, ""), (902, "..."), (None, items[1][1]), (100, "repeat")]
    return docs, items


@pytest.mark.parametrize("memory", [1 << 20, 3000])
def test_report(spark, memory):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(3))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("x"))
    assert sorted([tuple(r) for r in decontaminate.report(d, b, memory=memory).collect()], key=str) == brute_force(docs, items)


def test_clean_documents_and_spans(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"Start {item.upper()}, end.", "k"), (2, "nothing here", "k"), (3, None, "k"), (4, f"Start {item} end. " + "free " * 400, "k")]
    d = spark.createDataFrame(docs, "doc_id long, text string, items string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.clean(d, b, mode="span").collect()}
    assert cut[1] == "Start , end." and cut[2] == "nothing here" and cut[3] is None and item not in cut[4]


def test_nothing_to_find(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(d, none).first()["contaminated"] is False
    assert decontaminate.report(d.limit(0), none).count() == 0


@pytest.mark.parametrize("memory", [1 << 28, 4000])
def test_long_texts_and_repeated_windows(spark, memory):
    rng = random.Random(3)
    passage = [f"w{i}" for i in range(40)]
    items = [(1, "same " * 500), (2, "same " * 13), (3, " ".join(passage)), (3, " ".join(passage)), (4, "Word")]
    long = [f"x{rng.randrange(1000)}" for _ in range(50_000)]
    docs = [(1, " ".join(long[:30_000] + passage + long[30_000:])), (2, "same " * 300), (3, "word " * 3), (4, "y" * 500_000), (4, " ".join(passage[5:30])), (5, "Ä" * 3)]
    got = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), memory=memory)
    wanted = [(1, 50_040, 40, "3", False), (2, 300, 300, "1,2", True), (3, 3, 3, "4", True), (4, 1, 0, "", False), (4, 25, 25, "3", True), (5, 1, 0, "", False)]
    wanted = [(i, n, h, len(s.split(",")) if s else 0, hashlib.sha256(s.encode()).hexdigest(), c) for i, n, h, s, c in wanted]
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(wanted, key=str)


def test_a_set_is_small_and_bounded():
    rng = random.Random(5)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(1000))) for i in range(300)]
    whole = list(decontaminate.blocks(iter(items), 13, 1 << 30))
    assert len(whole) == 1 and whole[0].size() < 30 * 300_000 + 200 * 20_000
    parts = list(decontaminate.blocks(iter(items), 13, whole[0].size() // 4))
    assert 4 <= len(parts) <= 16 and sum(len(h) for p in parts for h, *_ in p.windows.values()) == 300 * 988


def test_items_without_an_id(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(None, passage), (None, "some other words"), (7, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, passage), (2, "some other words"), (3, "clean")], "doc_id long, text string")
    for memory in (10, 1 << 20):
        got = {r["doc_id"]: r for r in decontaminate.report(docs, items, memory=memory).collect()}
        assert [(got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) for i in (1, 2, 3)] == [(20, 2, True), (3, 1, True), (0, 0, False)]
        assert [got[i]["items_sha256"] for i in (1, 2)] == [hashlib.sha256(s).hexdigest() for s in (b"7", b"")]
        assert [r["doc_id"] for r in decontaminate.clean(docs, items, memory=memory).collect()] == [3]


def test_equal_windows_are_visited_once(spark):
    import time

    items = spark.range(100_000).select(F.col("id").alias("item_id"), F.lit("the").alias("text"))
    docs = spark.createDataFrame([(1, "the " * 100_000), (2, "other"), (3, "x the y")], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in decontaminate.report(docs, items).collect()}
    assert time.time() - began < 60
    digest = hashlib.sha256(",".join(sorted(map(str, range(100_000)))).encode()).hexdigest()
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in (1, 2, 3)] == [(100_000, 100_000), (0, 0), (1, 100_000)] and got[1]["items_sha256"] == got[3]["items_sha256"] == digest


@pytest.mark.parametrize("bits", [0, 2])
def test_windows_that_share_a_hash(monkeypatch, bits):
    plain = decontaminate.NgramSet._hash
    monkeypatch.setattr(decontaminate.NgramSet, "_hash", staticmethod(lambda columns: plain(columns) & np.uint64((1 << bits) - 1)))
    rng = random.Random(bits)
    say = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    items = [(i, say(rng.randrange(0, 9))) for i in range(40)] + [(None, "a b")]
    docs = [(i, say(rng.randrange(0, 30))) for i in range(60)]
    held = decontaminate.NgramSet(4)
    for i, t in items:
        held.add(i, t)
    held.sealed()
    for (_, text), wanted in zip(docs, sorted(brute_force(docs, items, 4), key=lambda r: r[0])):
        hit, found = held.find(decontaminate.words(text))
        assert (0 if hit is None else int(hit.sum()), len(found)) == wanted[2:4]
