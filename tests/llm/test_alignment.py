"""Alignment of tokenizers against plain loops over all pairs of tokens."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

from echolake.llm import alignment, packing

A, B = packing.tokenizer_path(), alignment.piece_path()


@functools.cache
def tokenizers():
    full = Tokenizer.from_file(A)
    full.encode_special_tokens = True
    return full, SentencePieceProcessor(model_file=B), alignment.byte_level(A)


@functools.cache
def word_encoders():
    return alignment.Pieces(B), alignment.Plain(A)


def plain_tokens(text):
    full, model, table = tokenizers()
    a = [(i, table[i]) for i in full.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        piece = model.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and model.is_byte(i) else piece.replace("▁", " ").encode()))
    return a, b


def brute_force(docs):
    linked, rows = [], []
    for i, text in docs:
        a, b = plain_tokens(text) if text else ([], [])
        spelled = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != spelled or b"".join(x for _, x in b) != spelled:
            rows.append((i, 0, 0, 0, ""))
            linked.append([])
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for t, x in side:
                out.append((at, at + len(x), t))
                at += len(x)
            spans.append(out)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        low, groups = 0, []
        for e in ends:
            groups.append("|".join(",".join(str(t) for s, f, t in side if low < f <= e) for side in spans))
            low = e
        links = [(x, y) for s, e, x in spans[0] for p, q, y in spans[1] if s < q and p < e]
        rows.append((i, len(a), len(b), len(ends), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        linked.append(links)
    counts = Counter(x for links in linked for x in links)
    top: dict = {}
    for (_, y), n in counts.items():
        top[y] = max(n, top.get(y, 0))
    return sorted([(i, n_a, n_b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest) for (i, n_a, n_b, g, digest), links in zip(rows, linked)], key=str)


def aligned(docs):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted([tuple(r[c] for c in columns) for r in alignment.align(docs, A, B).collect()], key=str)


ODD = [
    (1, None),
    (2, ""),
    (3, "some words, and Some more words"),
    (3, "some words, and Some more words"),
    (None, "no id"),
    (4, " leading, trailing "),
    (5, "two  spaces\n\n\tand lines\r\n"),
    (6, "<|endoftext|> <s> </s> <unk> <0x41> plain"),
    (7, "é ſ ﬁ ① 漢字 \U0001f600 ɐ́"),
    (8, "a ▁ block"),
    (9, "▁"),
    (10, "\x00\x01 \x85\xa0　x"),
    (11, "antidisestablishmentarianism" * 5),
    (12, "words of a long text " * 400),
    (13, " "),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    wanted = brute_force(ODD)
    assert aligned(docs.repartition(3)) == wanted
    assert [r[1:] for r in wanted if r[0] in (1, 2, 8, 9)] == [(0, 0, 0, 0, 0, 0, "")] * 4
    clash = docs.withColumns({c: F.lit("x") for c in ("a", "b", "pair", "n", "n_groups", "shard", "counts")})
    assert aligned(clash) == wanted
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert aligned(docs.where("doc_id < 3")) == brute_force(ODD[:2])


def test_many_tasks_and_small_tables(spark, monkeypatch):
    words = [f"w{k % 37} Wörter{k % 11}, {k}" for k in range(300)]
    docs = [(k, " ".join(words[k : k + k % 9])) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several shards
    try:
        assert aligned(frame) == brute_force(docs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_full_tables_are_sent_in_between(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(alignment, "KEPT", 4)
    sent = []

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            sent.append(run)

    alignment.partial_counts(Frame(), A, B)
    aligner = alignment.Aligner(A, B)
    texts = ["one two three four", "five six", "one two seven", "one"]
    both = [aligner.tokens(t) for t in texts]
    batches = [pa.RecordBatch.from_arrays([pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["a", "b"]) for a, b in both]
    total: Counter = Counter()
    rows = 0
    for b in sent[0](iter(batches)):
        rows += b.num_rows
        for pair, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            total[pair] += n
    wanted: Counter = Counter()
    for t in texts:
        a, b = plain_tokens(t)
        assert len(a) == len(b)
        wanted.update((y << 32) + x for (x, _), (y, _) in zip(a, b))
    assert total == wanted and rows > len(wanted)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("ab  .'\n\té▁漢1") + ["<|endoftext|>", "the ", "don't "]), min_size=1, max_size=40).map("".join))
def test_words_by_themselves(text):
    pieces, plain = word_encoders()
    assert pieces(text) == pieces.whole(text)
    assert plain(" " + text) == plain.whole(" " + text)


def test_bytes_of_entries():
    table = alignment.byte_level(A)
    assert len({x for x in table if len(x) == 1}) == 256
    full, decoder = Tokenizer.from_file(A), ByteLevel()
    for i in range(0, len(table) - 1, 97):
        assert table[i].decode("utf-8", "replace") == decoder.decode([full.id_to_token(i)])


def test_elsewhere_than_a_mounted_folder(tmp_path, monkeypatch):
    # a store that isn't a local file system is copied from, and the copies go
    import pyarrow.fs as fs

    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    alignment._write(f"file://{tmp_path}", "pairs-1", [np.arange(5, dtype="<i8").tobytes()])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["pairs-1"]

    class Elsewhere:
        LocalFileSystem = fs.LocalFileSystem
        FileSystem = type("FileSystem", (), {"from_uri": staticmethod(lambda uri: (store, ""))})
        copy_files = staticmethod(fs.copy_files)

    monkeypatch.setattr(alignment.pa, "fs", Elsewhere)
    with alignment._mapped("other://x", ["pairs-1"]) as files:
        assert files[0].tolist() == [0, 1, 2, 3, 4]
        held = files[0].filename
        assert not str(held).startswith(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        open(held)


def test_words_are_aligned_once_as_whole_texts_are():
    import public_tokenizers

    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), alignment.piece_path())
    texts = ["Plain words, said twice: plain words.", "naïve café 12345 a\nb x_y_z", "été ﬁne ok", "don't stop", "日本語 and more", "  led by blanks", "a <|endoftext|> b", "x"]
    for text in [*texts, *texts]:  # the second time from what is remembered
        a, b = aligner.tokens(text)
        groups = b"".join(aligner.pieces(a, b)) if a else b""
        wanted = (a, b, groups.count(b";"), hashlib.sha256(groups[:-1]).hexdigest()) if a else (b"", b"", 0, "")
        assert aligner.document(text) == wanted, text
    assert aligner.words["words,"]
