"""Vector packing: limits kept, nothing lost, nothing padded; ids and checksums against the tokenizer itself."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echolake.llm import packing, vector_packing
from echolake.llm.vector_packing import Limits, dot_product_packing

END = vector_packing.END


def held(got, tokens, prompts, limits):
    """Tokens of each sequence, after all that must hold of any packing was tested."""
    pieces: dict = {}
    sequences: dict = {}
    for item, start, length, sequence, place in got:
        loss = length - max(0, min(prompts[item], start + length) - start)
        pieces.setdefault(item, []).append((start, length))
        sequences.setdefault(sequence, []).append((place, length, loss))
    assert set(pieces) == set(range(len(tokens)))
    for item, parts in pieces.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == tokens[item] and min(n for _, n in parts) > 0
    for parts in sequences.values():
        ends = np.cumsum([n for _, n, _ in sorted(parts)])
        assert [p for p, _, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] <= limits.tokens and len(parts) <= limits.segments and sum(x for _, _, x in parts) <= limits.loss
    return [sum(n for _, n, _ in parts) for parts in sequences.values()]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), min_size=1, max_size=60), st.sampled_from([Limits(32, 8, 32), Limits(32, 2, 32), Limits(48, 5, 11), Limits(30, 1, 30), Limits(1, 1, 1)]))
def test_any_items(items, limits):
    tokens, prompts = np.array(items).T
    sizes = held(dot_product_packing(tokens, prompts, limits), tokens, prompts, limits)
    assert all(n == limits.tokens or n & (n - 1) == 0 for n in sizes)
    held(dot_product_packing(tokens, prompts, limits, powers=False), tokens, prompts, limits)
    short = np.minimum(tokens, min(limits.tokens, limits.loss))
    got = dot_product_packing(short, prompts, limits, cut=False)
    held(got, short, prompts, limits)
    assert len(got) == len(items)  # nothing is cut


def test_the_dot_product_mixes_demands():
    # long prompts with short replies beside short prompts with long replies: either kind alone leaves half of a sequence empty
    tokens, prompts = np.array([60, 40] * 40), np.array([50, 0] * 40)
    limits = Limits(100, 2, 50)
    sizes = held(dot_product_packing(tokens, prompts, limits, cut=False), tokens, prompts, limits)
    assert len(sizes) == 40 and set(sizes) == {100}


def test_a_sequence_cuts_one_item_at_most():
    tokens = np.minimum(np.random.default_rng(5).lognormal(5, 1, 3000).astype(int) + 1, 2047)
    got = dot_product_packing(tokens, np.zeros(3000))
    sizes = held(got, tokens, np.zeros(3000), Limits())
    full = sum(n == 2048 for n in sizes)
    assert full == tokens.sum() // 2048 and len(got) - 3000 <= len(sizes)
    assert sum(np.bincount([g[0] for g in got]) > 1) < 0.03 * 3000


def test_beyond_a_limit():
    with pytest.raises(ValueError):
        dot_product_packing(np.array([10]), np.array([0]), Limits(20, 1, 9), cut=False)
    with pytest.raises(ValueError):
        dot_product_packing(np.array([10]), np.array([0]), Limits(20, 0, 9))


def test_items_of_several_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(t), int(p), f"x{i}") for i, (t, p) in enumerate(zip(rng.integers(0, 300, 500), rng.integers(0, 200, 500)))]
    items = spark.createDataFrame(rows, "row long, tokens long, prompt long, name string")
    limits = Limits(256, 6, 128)
    got = vector_packing.pack_items(items, limits, group=64).collect()
    assert len({r["_sequence"] >> 32 for r in got}) == 8 and all(r["name"] == f"x{r['row']}" for r in got)
    kept = [r for r in rows if r[1]]
    number = {r[0]: k for k, r in enumerate(kept)}
    sizes = held([(number[r["row"]], r["_start"], r["_length"], r["_sequence"], r["_place"]) for r in got], [r[1] for r in kept], [r[2] for r in kept], limits)
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes)
    assert vector_packing.pack_items(items.limit(0), limits).count() == 0


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id"), (4, "some words here " * 3000), (5, "<|endoftext|> é ſ \U0001f600"), (6, "a  b\n\n c ")] + [(10 + i, "tiny") for i in range(500)]


def test_documents(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "tokens", "ids", "start", "length", "crc", "_group")})
    path = packing.tokenizer_path()
    got = vector_packing.pack_documents(docs, path, group=100).collect()
    full = Tokenizer.from_file(path)
    wanted = [(i, full.encode(t or "", add_special_tokens=False).ids + [END]) for i, t in ODD]
    by_id: dict = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert set(by_id) == {i for i, _ in wanted}
    for i, ids in wanted:
        rows = sorted(by_id[i], key=lambda r: r["start"])
        copies = sum(j == i for j, _ in wanted)
        assert sum(r["length"] for r in rows) == copies * len(ids) and all(r["doc_tokens"] == len(ids) for r in rows)
        for r in rows:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)]).tolist()
        assert [p for p, _ in sorted(parts)] == [0, *ends[:-1]] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0) and len(parts) <= 128
    assert vector_packing.pack_documents(docs.limit(0), path).count() == 0
