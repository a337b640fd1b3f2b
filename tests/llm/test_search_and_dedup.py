from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.llm import mtree, near_dedup
from echolake.llm.base import maybe_in


def top(rows, k=10, modulus=100, kind=np.float32):
    vs = [(i, [int(np.floor(1024 * float(kind(x)))) for x in v]) for i, v in rows if i is not None and v is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, v) in enumerate(vs):
        if q % modulus == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i) for b, (i, w) in enumerate(vs) if a != b and len(w) == len(v))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(700)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(150)]  # copies, some of them queries
    rows += [(300, rows[5][1]), (2000, None), (2100, [float("nan")] * 5), (2200, [1.0, None, 1.0, 1.0, 1.0]), (None, [9.0] * 5), (2300, [1.0, 2.0]), (2301, [3.0, 4.0]), (2400, [float("inf")] * 5), (2500, [300.0, 2.0, 0.0, -5.0, 60000.0]), (2600, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = mtree.top_k(df, block=100, query_block=3, least_blocks=4)
    assert sorted(tuple(r) for r in got.collect()) == top(rows)


@pytest.mark.parametrize("rows", [[(0, [1.0, 1.0]), (1, [70000.0, 1.0]), (2, [2.0, 2.0])], [(i, [float(i) * 3e3, 2.0**19 + i / 8, -1.0 / 3]) for i in range(120)], [(0, [1.0, 0.0]), (1, [-1e300, 5.0]), (2, [0.5, 1e16]), (3, [3.0, 0.0])], [(0, [1e-3, 0.0]), (100, [0.0, 1e-3]), (2, [1e-3, 1e15])]])
def test_large_components(spark, rows):
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, block=16, query_block=2, least_blocks=2)
    assert sorted(tuple(r) for r in got.collect()) == top(rows, k=2, kind=float)


def test_a_score_that_no_long_holds_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e10, 0.0]), (1, [1e12, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="exceeds a long"):
        mtree.top_k(df).collect()


def test_clustered_blocks_are_spared(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6)) * 50
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.1).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in mtree.top_k(df, block=200, least_blocks=12).collect()) == top(rows)


def test_few_vectors(spark):
    assert mtree.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert mtree.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_tree_prunes_and_is_exact():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 8)) * 3000
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 8)) * 20)
    tree = mtree.MTree(x, np.arange(6000), page=32)
    for q in range(0, 6000, 500):
        tree.computed = 0
        got = tree.search(x[q], q, 10)
        scores = x @ x[q]
        scores[q] = -np.inf
        order = np.lexsort((np.arange(6000), -scores))[:10]
        assert got == [(int(scores[i]), int(i)) for i in order]
        assert tree.computed < 3000


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        both = len(a & b)
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i) for i, s in sets], key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, text))
        n += 1

    passage = " ".join(word() for _ in range(60))
    base = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(12)]
    for b in base:
        add(" ".join(b))
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = word()
            add(rng.choice(["  ", " ", "\n"]).join(c).upper() if rng.random() < 0.3 else " ".join(c))
    hot = [word() for _ in range(90)]
    for k in range(120):  # one large group of near copies
        c = list(hot)
        c[k % 90] = word()
        add(" ".join(c))
    for _ in range(60):  # exact copies
        add(" ".join(base[0]))
    for _ in range(60):  # a passage that many share
        add(passage + " " + " ".join(word() for _ in range(rng.randrange(10, 60))))
    chain = [word() for _ in range(60)]
    for k in range(30):  # a chain: neighbours are alike, ends are not
        add(" ".join(chain))
        chain[k * 2 : k * 2 + 1] = [word()]
    for t in ("", None, " \t ", "one", "One", "one two", "one two three four", "a b", "a b"):
        add(t)
    return rows


def test_components_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted([tuple(r) for r in near_dedup.components_of(df).collect()], key=str)
    assert got == brute_force(rows)


def test_odd_rows(spark):
    rows = [(5, "w x y z"), (5, "w x y z"), (None, "w x y z"), (None, "q r s t"), (2, "w x y z"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in near_dedup.components_of(df).collect()], key=str)
    assert got == sorted([(5, 1, 2, False), (5, 1, 2, False), (None, 1, 2, True), (None, 1, None, True), (2, 1, 2, True), (9, 0, 9, True)], key=str)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted([r["doc_id"] for r in kept.collect()], key=str) == [2, 9, None, None]
    assert near_dedup.components_of(df.limit(0)).count() == 0


def test_repeats_count_once(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_dedup.deduplicate(df).collect()) == [1, 2]


@pytest.mark.parametrize("shape", ["path", "random"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] if shape == "path" else [(rng.randrange(300), rng.randrange(300, 600)) for _ in range(350)]
    rng.shuffle(links)
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r["id"]: r["component"] for r in near_dedup.components(df).collect()} == {x: root(x) for x in up}


def test_region_pairs_connect_every_row():
    rng = random.Random(6)
    keys = sorted(bytes([0, 1, 0, 1, 0, 1, *(0 if rng.random() < 0.5 else rng.randrange(3) for _ in range(10))]) for _ in range(200))
    pairs = list(near_dedup.region_pairs(keys, 0, 200, 3))
    up = list(range(200))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in pairs:
        up[root(j)] = root(i)
    assert len({root(i) for i in range(200)}) == 1 and len(pairs) < 200 * 4


def test_maybe_in(spark):
    df = spark.createDataFrame([(i if i % 10 else None, f"t{i}") for i in range(1000)], "id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 1000, 7)], "x long")
    inside, outside = maybe_in(df, "id", ids).collect(), maybe_in(df, "id", ids, keep=False).collect()
    assert len(inside) + len(outside) == 1000 and {r["id"] for r in inside} >= {i for i in range(0, 1000, 7) if i % 10}
    assert len(inside) < 200 and None not in {r["id"] for r in inside}
    assert maybe_in(df, "id", ids.limit(0)).count() == 0


def star(leaves, at=0, seed=11):
    """A text of 400 shingles and its ``leaves`` copies with ten words changed: each is like the text, none like another."""
    rng = random.Random(seed)
    hub = [f"h{i}" for i in range(403)]
    rows = [(at + leaves, " ".join(hub))]
    for k in range(leaves):
        c = list(hub)
        for i in rng.sample(range(100), 10):
            c[4 * i + 1] = f"e{k}x{i}"
        rows.append((at + k, " ".join(c)))
    return rows


def test_a_text_with_many_different_copies(spark):
    rows = star(1000)
    sets = [shingles(t) for _, t in rows[:40]]
    like = lambda a, b: len(a & b) / len(a | b)
    assert all(0.8 <= like(sets[0], s) < 0.85 for s in sets[1:])
    assert all(like(a, b) < 0.8 for a, b in itertools.combinations(sets[1:], 2))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.components_of(df).collect()} == {0}


def links_of(rows, threshold=80):
    sets = {i: shingles(t) for i, t in rows}
    return {(i, j) for (i, a), (j, b) in itertools.combinations(sorted(sets.items()), 2) if a and 100 * len(a & b) >= threshold * len(a | b)}


def crowd(n, seed=3, shared=170, own=34, pairs=0):
    """Pages that share a template and are not alike (similarity about 0.7), and ``pairs`` of near copies among them."""
    rng = random.Random(seed)
    template = [f"t{i}" for i in range(shared)]
    rows = []
    for i in range(n):
        mine = [f"p{i}x{j}" for j in range(own + rng.randrange(-4, 5))]
        rows.append((2 * i, " ".join(template + mine)))
        if i < pairs:
            mine[rng.randrange(len(mine))] = f"q{i}"
            rows.append((2 * i + 1, " ".join(template + mine)))
    return rows


def test_prefix_pairs_against_brute_force(spark):
    rng = random.Random(9)
    rows = star(30) + crowd(60, pairs=20) + [(5000 + i, t) for i, t in corpus(4)[:150]] + [(9000 + i, " ".join(rng.choice("abc") for _ in range(rng.randrange(4, 30)))) for i in range(80)]
    rows = [(i + 10**4 * k, t) for k, (i, t) in enumerate(rows) if shingles(t)]
    texts = spark.createDataFrame(rows, "id long, text string")
    held = texts.select(F.col("id").alias("rep"), F.col("id").alias("component"))
    met = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(held, texts).collect()}
    wanted = links_of(rows)
    assert len(wanted) > 100 and met >= wanted
    one = held.withColumn("component", F.lit(0).cast("long"))
    assert near_dedup.prefix_pairs(one, texts).count() == 0


def test_a_crowd_of_templated_pages(spark):
    rows = crowd(900, pairs=250)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r["doc_id"], r["component_id"]) for r in near_dedup.components_of(df).collect()])
    assert got == sorted((i, i - i % 2) for i, _ in rows)


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (8, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.create_map(F.lit("k"), F.col("text")))
    assert {(r["doc_id"], r["component_id"]) for r in near_dedup.components_of(df).collect()} == {(3, 3), (5, 3), (7, 3), (8, 8)}
    kept = near_dedup.deduplicate(spark.createDataFrame([(8, c), (8, "z y"), (9, "z y x w")], "doc_id long, text string").withColumn("extra", F.create_map(F.lit("k"), F.col("text"))))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(8, c), (8, "z y"), (9, "z y x w")])  # texts that are not alike stay each


def test_long_texts(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(10**6)}" for _ in range(130_000)]
    other = list(words)
    for i in range(0, 130_000, 1000):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 300_000), (4, " ".join(words[:100_000]))]
    got = {r["doc_id"]: r for r in near_dedup.components_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1]["n_shingles"] == len(shingles(rows[0][1]))


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 11])
def test_the_filter_only_saves_work(spark, most_bits):
    df = spark.createDataFrame([(i,) for i in range(5000)], "id long")
    ids = spark.createDataFrame([(i,) for i in range(0, 5000, 2)], "x long")
    inside = {r["id"] for r in maybe_in(df, "id", ids, most_bits=most_bits).collect()}
    assert inside >= set(range(0, 5000, 2))
    assert {r["id"] for r in maybe_in(df, "id", ids, keep=False, most_bits=most_bits).collect()} == set(range(5000)) - inside


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(mtree, "BYTES", 8 * 16 * 40)  # 40 vectors of 16 numbers
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(400)] + [(1000 + i, [0.25] * 16) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in mtree.top_k(df, k=4, modulus=50, least_blocks=1).orderBy("query_id", "rank").collect()]
    v = {i: np.floor(1024 * np.array(x, dtype=np.float32).astype(np.float64)) for i, x in rows}
    wanted = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:4]
            wanted += [(q, k, c, -s) for k, (s, c) in enumerate(best, 1)]
    assert got == wanted


def test_components_beyond_doubles_are_an_error(spark):
    df = spark.createDataFrame([(0, [1e306, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="1024 exceeds a double"):
        mtree.top_k(df).collect()
