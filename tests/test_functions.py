from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from echolake.functions import entities, hashing, keys, requests, screen, sse, vectors, wordpiece


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} {types[type(v)] if not isinstance(v, list) else 'array<double>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_fnv_known_values(spark):
    for text, wanted in (("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("abc", "e71fa2190541574b"), ("foobar", "85944171f73967e8")):
        assert one(spark, hashing.fnv1a_hex(F.col("t")), t=text) == wanted


@pytest.mark.parametrize(
    ("text", "numbers", "acronyms", "identifiers"),
    [("GPT-4 and HTTP2 in 2024", ["2024", "4"], ["GPT"], ["HTTP2"]), ("nothing here", [], [], []), ("版本3对比版本4 API", ["3", "4"], ["API"], []), ("Abc aBC A", [], ["A"], [])],
)
def test_entity_tokens(spark, text, numbers, acronyms, identifiers):
    got = one(spark, entities.entity_tokens(F.col("t")), t=text)
    assert (got["numbers"], got["acronyms"], got["identifiers"]) == (numbers, acronyms, identifiers)


def test_entity_veto_is_symmetric(spark):
    rows = [("rate 2023", "rate 2024", True), ("rate 2023", "2023 rate", False), ("rate", "rate 5", True), ("a b", "c d", False)]
    df = spark.createDataFrame(rows, "a string, b string, wanted boolean").select("wanted", entities.entity_mismatch(entities.entity_tokens("a"), entities.entity_tokens("b")).alias("ab"), entities.entity_mismatch(entities.entity_tokens("b"), entities.entity_tokens("a")).alias("ba"))
    for r in df.collect():
        assert r["ab"] == r["ba"] == r["wanted"]


def test_screen_order_and_bytes(spark):
    s = screen.screen_input(F.col("t"), block_urls=True, keywords=["secret"], max_bytes=5)
    assert one(spark, s, t="IGNORE PREVIOUS http://x")["reason"] == screen.REASONS["injection"]
    assert one(spark, s, t="secret http://x")["reason"] == screen.REASONS["url_in"]
    assert one(spark, s, t="Secret!")["action"] == "truncate"  # keywords are matched as spelt
    assert one(spark, s, t="ab")["action"] == "pass"
    assert one(spark, s, t="ééé")["action"] == "truncate"  # six bytes
    assert one(spark, screen.truncate_bytes(F.col("t"), 5), t="ééé") == "ééé".encode()[:5]
    for good in ("new instructions please", "http://", "system prompt"):
        assert one(spark, screen.screen_input(F.col("t"), block_urls=True), t=good)["action"] == "pass"


def test_keys(spark):
    assert one(spark, keys.cache_key(F.col("n"), F.lit(7)), n="ns1") == "ns1:msg:7"
    assert one(spark, keys.cache_key(F.col("n"), F.lit(7)), n="") == "msg:7"
    for key, wanted in (("msg:12", 12), ("ns:msg:3", 3), ("xmsg:3", None), ("msg:3a", None), ("msg:", None), (f"msg:{1 << 40}", None), ("msg:99999999999999999999", None)):
        assert one(spark, keys.message_id(F.col("k")), k=key) == wanted
    ns = "ns0123456789abcdef"
    assert one(spark, keys.strip_namespace(F.col("k")), k=f"{ns}:what") == "what"
    assert one(spark, keys.same_namespace(F.col("k"), F.lit("")), k=f"{ns}:msg:1") is False
    assert one(spark, keys.in_namespace(F.col("k"), F.lit("")), k=f"{ns}:msg:1") is True
    assert one(spark, keys.fingerprint_differs(F.lit("a"), F.col("k")), k="") is True
    assert one(spark, keys.fingerprint_differs(F.lit(""), F.col("k")), k="b") is False


def test_vectors(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=8).tolist(), rng.normal(size=8).tolist()
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-7)
    assert one(spark, vectors.l2(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(np.linalg.norm(np.subtract(a, b)))
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=a, b=b[:3]) is None
    assert np.linalg.norm(one(spark, vectors.normalise(F.col("a")), a=a)) == pytest.approx(1)
    pairs = spark.createDataFrame([(a, b), (a, a), (a, b[:3]), (None, b), ([0.0], [1.0]), ([], [])], "a array<double>, b array<double>")
    both = pairs.select(vectors.cosine("a", "b").alias("x"), vectors.cosine_batch("a", "b").alias("y")).collect()
    assert [r["y"] for r in both] == pytest.approx([r["x"] for r in both])
    hidden = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "h array<array<double>>, m array<int>")
    got = hidden.select(vectors.mean_pool(F.col("h"), F.col("m")).alias("mean"), vectors.cls_pool(F.col("h")).alias("cls")).first()
    assert got["mean"] == [2.0, 3.0] and got["cls"] == [1.0, 2.0]
    bad = spark.createDataFrame([("!!", 2), ("AAAA", 2)], "t string, d int").select(vectors.decode_vector("t", "d").alias("v"))
    assert [r["v"] for r in bad.collect()] == [[], []]


BODY = {
    "messages": [
        {"role": "system", "content": "be brief"},
        "not an object",
        {"role": "user", "content": [{"type": "text", "text": "hi "}, {"type": "image_url"}, "there"]},
        {"role": "assistant", "content": None},
        {"role": "system", "content": "and kind"},
        {"role": "user", "content": "last"},
    ],
    "stream": True,
    "stream_options": {"include_usage": "true"},
}


def test_requests(spark):
    bodies = [json.dumps(BODY), "no json", "{}", json.dumps({"messages": [{"role": "user", "content": "x", "tool_calls": []}]}), json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": ""}], "stream": "true"})]
    rows = requests.classify(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "request_id int, body string")).orderBy("request_id").collect()
    assert rows[0]["user_text"] == "last" and rows[0]["all_text"] == "be brief\nhi there\nand kind\nlast"
    assert rows[0]["is_stream"] and not rows[0]["include_usage"] and not rows[0]["is_tool"]
    wanted = one(spark, hashing.fnv1a_hex(F.col("t")), t="be brief\nand kind")
    assert rows[0]["namespace"] == "ns" + wanted
    for r in rows[1:3]:
        assert (r["namespace"], r["user_text"], r["is_stream"], r["is_tool"]) == ("", "", False, False)
    assert rows[3]["is_tool"]
    assert rows[4]["user_text"] == "" and not rows[4]["is_stream"]


def test_annotate(spark):
    assert json.loads(one(spark, requests.annotate_status(F.col("b"), F.lit("hit")), b='{"a": 1}')) == {"a": 1, "_cache": "hit"}
    assert json.loads(one(spark, requests.annotate_status(F.col("b"), F.lit("hit")), b="{ }")) == {"_cache": "hit"}
    assert one(spark, requests.annotate_status(F.col("b"), F.lit("hit")), b="[1]") == "[1]"
    assert one(spark, requests.upstream_status(F.col("s")), s=0) == 502


def test_sse(spark):
    text = 'event: x\r\ndata: {"choices":[{"delta":{"content":"a"}}]}\r\n\r\ndata: {"choices":[{"message":{"content":"b"}},{"delta":{"content":5}}]}\n\ndata: oops\n\ndata: {"usage": {"prompt_tokens": 3, "completion_tokens":4}}\n\ndata: [DONE]'
    assert one(spark, sse.content(F.col("t")), t=text) == "ab"
    assert one(spark, F.size(sse.events(F.col("t"))), t=text) == 5
    assert one(spark, sse.usage(F.col("t")), t=text).asDict() == {"prompt_tokens": 3, "completion_tokens": 4, "seen": True}
    assert not one(spark, sse.usage(F.col("t")), t='data: {"prompt_tokens": 3}')["seen"]
    assert one(spark, sse.replay(F.col("t")), t="data: x\n\n").endswith(sse.DONE_EVENT)
    assert one(spark, sse.abort_reason(F.lit(False), F.lit(True), F.lit(True), F.lit(True)), t="") == "upstream_idle"


def test_wordpiece(spark):
    vocabulary = {"[UNK]": 100, "un": 1, "##aff": 2, "##able": 3, "run": 4, "!": 5, "你": 6}
    words = wordpiece.basic_tokens(F.col("t"))
    df = spark.createDataFrame([("UNaffable run! 你好",), ("x" * 200,), ("tab\tand​zero",)], "t string")
    got = df.select(words.alias("w"), wordpiece.encode(wordpiece.wordpiece(vocabulary)(words)).alias("ids")).collect()
    assert got[0]["w"] == ["unaffable", "run", "!", "你", "好"]
    assert got[0]["ids"] == [101, 1, 2, 3, 4, 5, 6, 100, 102]
    assert got[1]["ids"] == [101, 100, 102]
    assert got[2]["w"] == ["tab", "andzero"]


def test_pieces_by_tries_equal_the_longest_known_piece(spark):
    import random

    from echolake.functions import wordpiece

    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abé#") for _ in range(n))
    vocabulary = {p: i for i, p in enumerate({*"ab", "##a", "##b", "##", "#", *(say(rng.randrange(1, 5)) for _ in range(20)), *("##" + say(rng.randrange(1, 5)) for _ in range(25))}, 200)}
    words = [say(rng.randrange(0, 9)) for _ in range(400)] + ["a" * 100, "a" * 101, "##a", "###"]

    def plain(word):
        out, at = [], 0
        while at < len(word) <= wordpiece.MAX_WORD:
            for end in range(len(word), at, -1):
                if (found := vocabulary.get(("##" if at else "") + word[at:end])) is not None:
                    out.append(found)
                    at = end
                    break
            else:
                return [wordpiece.UNK]
        return out if len(word) <= wordpiece.MAX_WORD else [wordpiece.UNK]

    df = spark.createDataFrame([(i, words[i : i + 7]) for i in range(0, len(words), 7)], "id long, words array<string>")
    got = {r["id"]: r["ids"] for r in df.select("id", wordpiece.wordpiece(vocabulary)("words").alias("ids")).collect()}
    assert got == {i: [x for w in words[i : i + 7] for x in plain(w)] for i in range(0, len(words), 7)}
