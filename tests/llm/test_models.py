from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.llm import langid, lm_scoring, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string"


def area(scores, truth):
    s, y = np.array(scores), np.array(truth)
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean()))


def sentences(rng, n):
    words = "river stone paper light window garden music winter number letter".split()
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(700):
        text, good, bad = sentences(rng, rng.randrange(20, 120)), 1, 0
        if rng.random() < 0.2:
            text, good = " ".join(w.upper() + "!!" for w in text.split()), 0
        if rng.random() < 0.15:
            at = text.split()
            for _ in range(3):
                at.insert(rng.randrange(len(at)), rng.choice(["you", "grobble", "Snarfle", "blivetish", "blivetous"]))
            text, bad = " ".join([*at, "grobble"]), 1
        docs.append((i, text, "en", f"src{i % 3}", "clash"))
        if i % 2 == 0 or bad:
            labels.append((i, good, bad))
    docs += [(9000, None, None, None, None), (9001, "", "", "", ""), (None, "no id", "en", "x", "y"), (9002, "word " * 50_000, "en", "s", "")]
    labels += [(0, labels[0][1], labels[0][2]), (None, 1, 1), (8888, 1, 0)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "column", "modulus", "fold"), [(quality, "quality", 3, 1), (toxicity, "toxic", 5, 0)])
def test_held_out(spark, labelled, operator, column, modulus, fold):
    docs, labels = labelled
    got = operator.classify(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % modulus == fold)
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    pairs = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert area(*zip(*pairs)) > 0.97


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_nothing_to_learn(spark, labelled, operator):
    docs, labels = labelled
    scores = {r["score"] for r in operator.classify(docs, labels.limit(0)).collect()}
    assert len(scores) == 1
    assert operator.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert operator.classify(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark, labelled):
    docs, labels = labelled
    turned = labels.withColumn("quality", F.when(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    key = lambda ls: sorted((str(r["doc_id"]), r["score"]) for r in quality.classify(docs, ls).collect())
    assert key(labels) == key(turned)


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1.5, 1, (3000, 2)), rng.normal(-1.5, 1, (3000, 2))
    unlabelled = np.vstack([p[:900], n[:2100]])
    model = quality.Quality.learn(p[1000:], unlabelled)
    assert abs(model.prior - 0.3) < 0.1
    z = model.net.forward(model.net.scaled(np.vstack([p[900:1000], n[2100:2200]])))[1]
    assert ((z > 0) == (np.arange(200) < 100)).mean() > 0.93


def test_quality_scores_against_brute_force(spark, labelled):
    """Features by plain loops over characters and words, the network by plain sums."""
    docs, labels = labelled
    model = quality.train(docs, labels)
    groups = [*[g.decode() for g in quality._CLASSES], None]

    def plain(text):
        raw = text.encode()
        n = max(len(raw), 1)
        shares = [sum((chr(b) in g if b < 128 else False) if g else b >= 128 for b in raw) / n for g in groups]
        ws, m = text.split(), max(len(text.split()), 1)
        lines = [x for x in text.split("\n") if x]
        k = max(len(lines), 1)
        letters = max(shares[0] + shares[1] + shares[-1], 1e-9)
        again = sum(a == b for a, b in zip(ws, ws[1:])) / m
        return [*shares, *map(math.sqrt, shares), math.log1p(len(ws)), len(text) / m, len(set(ws)) / m, math.log1p(len(set(ws))) / math.log1p(m), again, math.log1p(len(lines)), len(set(lines)) / k, math.log1p(len(ws) / k), shares[1] / letters, shares[8] * n / m, float(not ws), sum(bare(w) in model.common for w in ws) / m]

    bare = lambda w: w.lower().strip(quality._EDGE)
    assert "river" in model.common
    w1, b1, w2, b2 = (p.tolist() for p in model.net.p)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for r in docs.collect()[::23] + docs.where("doc_id >= 9000 and doc_id < 9002").collect():
        x = [min(max((v - m) / s, -6), 6) for v, m, s in zip(plain(r["text"] or ""), model.net.mean, model.net.scale)]
        h = [math.tanh(sum(a * row[j] for a, row in zip(x, w1)) + b1[j]) for j in range(len(b1))]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(h, w2)) - b2[0])), rel=1e-6)


def test_toxicity_scores_against_brute_force(spark, labelled):
    """Features by plain loops over the tokens, trees walked node by node, knots interpolated by hand."""
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    lexicon = model.lexicon

    def plain(text):
        tokens = text.split()
        marks = [lexicon.mark(t) for t in tokens]
        n, has = max(len(tokens), 1), lambda m, flag: bool(m & flag)
        hits = [i for i, m in enumerate(marks) if m & (toxicity.WORD | toxicity.PREFIX | toxicity.HIDDEN)]
        second = [i for i, m in enumerate(marks) if m & toxicity.SECOND]
        near = sum(any(abs(i - j) <= 5 for j in second) for i in hits)
        close = max((sum(i <= j < i + 100 for j in hits) for i in hits), default=0)
        c = [sum(has(m, 1 << k) for m in marks) for k in range(7)]
        return [c[0] / n, math.log1p(c[0]), c[1] / n, math.log1p(c[1]), len(hits) / n, close, len({tokens[i] for i in hits}), c[2] / n, near / n, near / max(len(hits), 1), c[3] / n, c[4] / n, c[5] / n, c[6] / n, text.count("!") / max(len(text), 1), text.count("?") / max(len(text), 1), math.log1p(len(tokens))]

    def walk(x):
        z = model.trees.base
        for feature, cut, value in model.trees.trees:
            k = 0
            while k < len(feature):
                k = 2 * k + 1 + (x[feature[k]] > cut[k])
            z += value[k - len(feature)]
        return z

    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    at, value = model.knots
    for r in docs.collect()[::23] + docs.where("doc_id >= 9000 and doc_id < 9002").collect():
        z = walk(plain(r["text"] or ""))
        above = [i for i, a in enumerate(at) if a >= z]
        if z < at[0] or not above:
            p = value[0] if z < at[0] else value[-1]
        else:
            j = above[0]
            p = value[j] if at[j] == z or not j else value[j - 1] + (value[j] - value[j - 1]) * (z - at[j - 1]) / (at[j] - at[j - 1])
        assert got[r["doc_id"]] == pytest.approx(0.998 * p + 0.002 / (1 + math.exp(-z)), rel=1e-6, abs=1e-9)


def test_long_words_enter_the_lexicon(spark):
    bad, rows = "b" * 300, []
    for i in range(120):
        rows.append((i, "plain words here " + (bad if i % 3 == 0 else "ok"), "en", "s", ""))
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, DOCS)
    assert bad in toxicity.train(df, labels).lexicon.words
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in toxicity.classify(df, labels).collect())


def test_small_samples_are_learnt_from(spark):
    rows = [(i, "calm text " * 3 if i % 2 else "nasty grobble " * 3, "en", "s", "") for i in range(18)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(18)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert min(got[i] for i in range(0, 18, 2)) > max(got[i] for i in range(1, 18, 2))


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_repeated_ids_are_scored_each(spark, labelled, operator):
    docs, labels = labelled
    again = docs.where("doc_id < 200").withColumn("text", F.concat(F.lit("zz "), "text"))
    both = docs.union(again)
    key = lambda df: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in operator.classify(df, labels).collect())
    got = key(both)
    assert len(got) == both.count() and got == key(both.repartition(7))  # of an id the smallest text is learnt from


def test_isotonic_and_trees():
    z, y = np.array([1.0, 2, 3, 4, 5, 5]), np.array([0.0, 1, 0, 1, 1, 0])
    at, value = toxicity.isotonic(z, y)
    assert (np.diff(value) >= 0).all() and np.interp(1.0, at, value) == 0 and np.interp(2.5, at, value) == 0.5
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = toxicity.Trees().fit(x[:1500], y[:1500])
    assert ((trees.raw(x[1500:]) > 0) == y[1500:]).mean() > 0.97


def test_marks_of_hidden_words():
    lexicon = toxicity.Lexicon(["=idiot", "^lowe"])
    assert lexicon.mark("Idiot!") & toxicity.WORD and lexicon.mark("loweich,") & toxicity.PREFIX
    for hidden in ("1d10t", "id.i.ot", "idiooot"):
        assert lexicon.mark(hidden) & toxicity.HIDDEN, hidden
    assert not lexicon.mark("plain") and lexicon.mark("LOUD") == toxicity.CAPITALS and lexicon.mark("you") == toxicity.SECOND


def test_distinct_hits_are_of_the_whole_text():
    lexicon = toxicity.Lexicon(["=idiot", "=moron"])
    assert lexicon.features("idiot " * 6000 + "moron")[6] == 2


LANGUAGES = {"en": "the and of to that with", "de": "der und die nicht mit schön", "fr": "le et été les dans où"}


def test_languages(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randrange(2, 60))), lang, "s", "") for i in range(600) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(7000, None, "en", "", ""), (7001, "12 34 !!", "en", "", ""), (7002, "der und", None, "", ""), (None, "le et", "fr", "", ""), (7003, "THE AND", "en", "", "")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:600] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.98
    assert all(got[r[0]]["held_out"] for r in held)
    assert got[7000]["lang_pred"] == got[7001]["lang_pred"] == "und"
    assert got[7002]["lang_pred"] == "de" and got[7003]["lang_pred"] == "en" and got[None]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_languages_with_little_to_learn(spark):
    one = spark.createDataFrame([(i, "abc def", "xx", "", "") for i in range(8)], DOCS)
    assert {r["lang_pred"] for r in langid.identify(one).collect()} == {"xx"}
    assert {r["lang_pred"] for r in langid.identify(one.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(one.limit(0)).count() == 0


def plain_ngrams(text):
    """Counts of the n-grams, by characters."""
    kept = [" "]
    for ch in text.lower():
        if ch.isalpha():
            kept.append(ch)
        elif kept[-1] != " ":
            kept.append(" ")
    kept = "".join(kept).rstrip(" ") + " "
    return Counter(kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)) if kept != " " else None


def number(gram):
    out = 0
    for ch in gram:
        out = out << 21 | ord(ch)
    return out


@pytest.mark.parametrize("chunk", [5, 1 << 20])
def test_ngrams_are_exact(monkeypatch, chunk):
    monkeypatch.setattr(langid, "CHUNK", chunk)
    rng = random.Random(1)
    texts = ["", "12 !", "a", "Ab c", "été, où?", "你好 世界 ǅ", *("".join(rng.choice("abcdé  .1ß𝒳") for _ in range(rng.randrange(60))) for _ in range(60))]
    grams = sorted({g for t in texts for g in plain_ngrams(t) or ()})
    features = langid.Features(np.array([number(g) for g in grams[::2]], dtype=np.uint64))
    place = {number(g): g for g in grams[::2]}
    for t in texts:
        wanted, got = plain_ngrams(t), features.counts(t)
        assert (got is None) == (wanted is None), t
        if wanted:
            assert {place[int(k)]: int(n) for k, n in zip(features.keys, got) if n} == {g: n for g, n in wanted.items() if g in place.values()}
    assert len(langid.Features(np.empty(0, dtype=np.uint64)).counts("abc")) == 0


def test_scores_of_languages_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(rng.randrange(2, 30))), lang, "s", "") for i in range(300) for lang in [rng.choice(list(LANGUAGES))]]
    rows += [(5, "der und", "de", "", ""), (800, "", "en", "", ""), (801, "the " * 400_000, "en", "", ""), (802, "жук", None, "", "")]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df)
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    seen = Counter(g for _, t, *_ in learnt for g in plain_ngrams(t) or ())
    n = sum(plain_ngrams(t) is not None for _, t, *_ in learnt)
    keys = {int(k): i for i, k in enumerate(model.features.keys)}
    for g in seen:
        if number(g) in keys:
            assert model.idf[keys[number(g)]] == pytest.approx(math.log((1 + n) / (1 + sum(g in (plain_ngrams(t) or ()) for _, t, *_ in learnt))) + 1)
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.identify(df).collect()}
    for doc_id, text, *_ in rows:
        counts = {keys[number(g)]: c for g, c in (plain_ngrams(text) or {}).items() if number(g) in keys}
        if plain_ngrams(text) is None:
            assert got[doc_id, "und"] == 0
            continue
        x = {i: c * model.idf[i] for i, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        z = [sum(v * model.weights[i][k] for i, v in x.items()) / (norm * model.temperature) for k in range(3)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        assert got[doc_id, model.names[int(np.argmax(p))]] == pytest.approx(max(p), rel=1e-6)


def test_rare_languages_are_learnt(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGUAGES["en"].split()) for _ in range(12)), "en", "s", "") for i in range(3000)]
    rows += [(9000 + i, " ".join(rng.choice(LANGUAGES["fr"].split()) for _ in range(12)), "fr", "s", "") for i in range(12)]
    df = spark.createDataFrame(rows, DOCS)
    chosen = langid.sample_of(df.select("doc_id", "lang"), 300, 50).collect()
    assert sum(r["lang"] == "fr" for r in chosen) == 12 and 230 <= sum(r["lang"] == "en" for r in chosen) <= 370
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert all(got[9000 + i] == "fr" for i in range(12))


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    model = langid.Ftrl(1100, 2, l1=0.5)
    for _ in range(300):
        label = int(rng.integers(2))
        model.learn(np.array([label, 10 + int(rng.integers(1000))]), np.array([0.9, 0.1]), label)
    w = model.weights()
    assert w[0, 0] > 0 > w[0, 1] and np.count_nonzero(w[10:1010]) == 0


def test_cross_entropy_difference(spark):
    rng = random.Random(5)
    near, far = "alpha beta gamma delta".split(), "one two three four".split()
    rows = [(i, " ".join(rng.choice(near if i % 2 else far) for _ in range(30)), "", "t" if i % 4 == 1 else None, "") for i in range(200)]
    rows += [(900, None, "", "t", ""), (901, "...", "", "t", ""), (902, "unseen words only", "", "b", "")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in lm_scoring.score(df, F.col("source") == "t").collect()}
    assert max(got[i]["score"] for i in range(1, 200, 2)) < min(got[i]["score"] for i in range(0, 200, 2))
    assert got[900]["score"] is None and got[901]["n_tokens"] == 0 and np.isfinite(got[902]["score"])
    # without a target all words are unknown, so that equally long texts score alike
    assert len({r["score"] for r in lm_scoring.score(df, F.lit(False)).collect() if r["n_tokens"] == 30}) == 1
    assert lm_scoring.score(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 5, 6, 7, 8, 100])
def test_vocabulary_settles_ties_by_hash(spark, size):
    count = {"a": 70, "b": 8, "c": 8, "d": 7, "e": 6, "f": 1, "g": 1, "h": 1}
    df = spark.createDataFrame([(" ".join([w] * n),) for w, n in count.items()], "text string")
    got = [w.decode() for w in lm_scoring.vocabulary(df, size)]
    assert len(got) == min(size, len(count)) and got == sorted(got, key=lambda w: (-count[w], w))
    assert all(count[w] >= count[v] for w in got for v in set(count) - set(got))
    assert set(lm_scoring.vocabulary(df.repartition(7), size)) == {w.encode() for w in got}


@pytest.mark.parametrize("many", [50_000, 50_001])
def test_vocabulary_of_words_that_are_all_as_frequent(spark, many):
    df = spark.range(0, many, 1, 8).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    assert len(set(lm_scoring.vocabulary(df))) == 50_000


def test_counts_are_of_all_documents(spark):
    df = spark.createDataFrame([(i, "x y", "", "t" if i < 30 else "b", "") for i in range(100)] + [(200, None, "", "t", "")], DOCS).repartition(5)
    ids = {w: k for k, w in enumerate(lm_scoring.vocabulary(df.where("source = 't'")), 1)}
    assert set(ids) == {b"x", b"y"}
    stored = lm_scoring.chunks(df, F.col("source") == "t", ids, ["doc_id"], chunk=12)
    assert stored.count() > 10
    good, back = lm_scoring.word_counts(stored, 4, stored.count())
    assert good.total == 60 and back.total == 140 and back.contexts[3] == 70 and good.unigrams[ids[b"x"]] == 30
    for r in lm_scoring.totals(stored, 4, 3, entries=1).collect():
        assert (np.frombuffer(r["good"], dtype="<u4").tolist(), np.frombuffer(r["back"], dtype="<u4").tolist()) == ([30], [70])


@pytest.mark.parametrize(("chunk", "bucket_tokens", "entries"), [(1000, 3000, 7), (10**6, 8 * 10**6, 16_384), (50_000, 10**6, 100)])
def test_losses_are_of_exact_bigram_counts(spark, chunk, bucket_tokens, entries):
    rng = random.Random(8)
    many = [0, 1, 2, 40_000]
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.5)), 1500)}" for _ in range(many[i % 50] if i % 50 < 4 else 400)), "", "t" if i % 2 else "b", "") for i in range(100)]
    rows += [(300, rows[7][1], "", "t", ""), (301, rows[7][1], "", "t", ""), (301, "w1", "", "b", ""), (None, "w1 w2", "", None, ""), (302, None, "", "t", ""), (303, "É-é W1", "", "b", "")]
    got = lm_scoring.score(spark.createDataFrame(rows, DOCS), F.col("source") == "t", chunk=chunk, bucket_tokens=bucket_tokens, entries=entries, size=900).collect()
    count = Counter(w for _, t, _, source, _ in rows if source == "t" for w in (t or "").split())
    known = {w.decode() for w in lm_scoring.vocabulary(spark.createDataFrame(rows, DOCS).where("source = 't'"), 900)}
    assert len(known) == 900 < len(count)
    texts = [([w if w in known else "" for w in (t or "").lower().replace("-", " ").split()], source == "t") for _, t, _, source, _ in rows]
    kinds = len(known) + 1
    losses = []
    for side in (True, False):
        one, two, first = Counter(), Counter(), Counter()
        for t, mine in texts:
            if mine == side:
                one.update(t)
                two.update(zip([None, *t], t))
                first.update([None, *t[:-1]] if t else [])
        losses.append([])
        for t, mine in texts:
            loss = 0.0
            # without the document's own counts
            a = Counter(t if mine == side else [])
            ab = Counter(zip([None, *t], t) if mine == side else [])
            aa = Counter([None, *t[:-1]] if t and mine == side else [])
            total = sum(one.values()) - sum(a.values())
            for b, w in zip([None, *t], t):
                p = 0.9 * (one[w] - a[w]) / total + 0.1 / kinds
                n = first[b] - aa[b]
                loss -= math.log(0.7 * (two[b, w] - ab[b, w]) / n + 0.3 * p if n else p)
            losses[-1].append(loss / len(t) if t else None)
    key = lambda r: (str(r[0]), r[1], r[2] or 0)
    wanted = sorted(((r[0], len(t), a, z, a if a is None else a - z) for r, (t, _), a, z in zip(rows, texts, *losses)), key=key)
    for g, w in zip(sorted([tuple(r) for r in got], key=key), wanted, strict=True):
        assert g[:2] == w[:2] and g[2:4] == (pytest.approx(w[2:4], rel=1e-9) if w[2] is not None else (None, None)) and (g[4] is None if w[4] is None else abs(g[4] - w[4]) < 1e-8)


def test_a_member_is_judged_as_a_stranger_is(spark):
    # a text of the target and its like elsewhere get the same score where they are the only ones of their kind
    rows = [(i, f"common words {i % 3} of all", "", "t" if i % 2 else "b", "") for i in range(40)]
    rows += [(100, "rare turn of phrase", "", "t", ""), (200, "odd turn of speech", "", "b", "")]
    got = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(rows, DOCS), F.col("source") == "t").collect()}
    assert got[100]["target_loss"] >= got[1]["target_loss"]
    alone = spark.createDataFrame([(1, "only one here", "", "t", ""), (2, "b c", "", "b", "")], DOCS)
    one = {r["doc_id"]: r for r in lm_scoring.score(alone, F.col("source") == "t").collect()}
    assert one[1]["target_loss"] == pytest.approx(math.log(4)) and one[2]["background_loss"] == pytest.approx(math.log(4))


def test_small_priors_are_not_raised():
    rng = np.random.default_rng(0)
    positive, other = rng.normal(6, 1, 4000), rng.normal(0, 1, 19_800)
    unlabelled = np.concatenate([other, rng.normal(6, 1, 200)])
    assert quality.class_prior(positive, unlabelled) == pytest.approx(0.01, rel=0.4)
    assert quality.class_prior(positive, rng.normal(6, 1, 400)) > 0.9


def test_lexicons_have_no_cap(spark):
    many = [f"{chr(97 + k % 26)}{k:05d}" for k in range(20_001)]
    rows = [(i, " ".join(many), 1) for i in range(40)] + [(100 + i, "plain words", 0) for i in range(40)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert len(toxicity.train(docs, labels).lexicon.words) == 20_001


@pytest.mark.parametrize("many", [8, 49, 50, 120])
def test_calibration_of_samples_of_any_size(spark, many):
    texts = {"en": "the house and the garden of the king", "fr": "la maison et le jardin du roi des"}
    rows = [(i, " ".join(texts[lang].split()[i % 5 :]), lang) for i in range(many) for lang in (("en", "fr")[i % 2],)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["en", "fr"] and 0.02 <= model.temperature <= 10
    assert [model.predict(t)[0] for t in texts.values()] == ["en", "fr"]
