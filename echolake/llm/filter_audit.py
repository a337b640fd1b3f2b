"""How five document filters act on each other, in every order of application.

Method.  Native expressions give every document a mask of the filters that it fails, one bit a filter.  Four filters look
at the text alone; the fifth asks for identical texts, which a grouping by the text's SHA-256 answers with the smallest id.
Documents become cells: a part (a source) has at most 32 masks, with counts of its documents and of those labelled good or
toxic.  A filter's effect depends on the set of filters before it and not on their order, so each part needs 5 x 16 counts, and
the 120 orders only look these up.

What is shuffled are rows of an id, a digest, a part and a mask, never a text; equal ones are merged before they move.  Copies
of one text stay apart by their ids until they are counts, so that no group of copies meets in one task.

Filters: A under 50 words; B under 65 % distinct words; C over 5 % capital letters A-Z; D one of ``#$%&*|``; E a text that a
smaller id has too.  Words are what white space (space, tab to carriage return) separates, case as written.

Defined cases: a null text is the empty one, which fails A alone (and E, if not the first); a null source is the empty
part; rows that repeat an id count each, and fail E only by a smaller id; rows without an id never fail E and let no other
row fail it; an id with several labels is good or toxic if any of them says so; labels without an id or a document are
ignored; an empty table gives no rows; extra columns are ignored; texts of any length are judged whole.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"

_SPACES, _CAPITALS = "[ \t-\r]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COUNTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text, not null, fails A to D."""
    words = F.array_remove(F.split(text, _SPACES), "")

    def bits(held: Column) -> Column:
        many, distinct = F.size(held), F.size(F.array_distinct(held))
        return F.when(many < LEAST_WORDS, 1).otherwise(0) + F.when(100 * distinct < DISTINCT_PERCENT * many, 2).otherwise(0)

    # a one-element transform, so that the words are split once
    first = F.transform(F.array(words), bits)[0]
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    third = F.when(100 * capitals > CAPITALS_PERCENT * F.length(text), 4).otherwise(0)
    return first + third + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five bits) and the counts n, good and toxic of each cell that has documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        text_mask(text).cast("int").alias("mask"),
        # rows without an id are spread over the tasks of the join, where they meet no label
        F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))).otherwise(0).alias("spread"),
    )
    merged = rows.groupBy("doc_id", "spread", "digest", "part", "mask").agg(F.count("*").alias("n"))
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    known = merged.join(judged, ["doc_id", "spread"], "left")
    # per text and kind of row: how many there are, and how many of them have the smallest id
    kinds = known.groupBy("digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "doc_id", "spread").agg(F.sum("n").alias("n"))
    kinds = kinds.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless")
    )
    first = F.min("least").over(Window.partitionBy("digest"))  # a row per text and kind
    kinds = kinds.withColumn("whole", F.col("nameless") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    split = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("whole").alias("k")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - F.col("whole")).alias("k"))))
    each = kinds.select("part", "good", "toxic", split.alias("c")).where("c.k > 0")
    return each.groupBy("part", F.col("c.m").alias("mask")).agg(F.sum("c.k").alias("n"), F.sum(F.col("c.k") * F.col("good")).alias("good"), F.sum(F.col("c.k") * F.col("toxic")).alias("toxic"))


def effects(cells: DataFrame) -> DataFrame:
    """Per part, filter (its number) and set of filters before it (a mask): what the filter does there, and ``shapley``, the sum
    of what it removes over all orders: a set of k filters stands before it in k!(4-k)! of them."""
    last = len(FILTERS) - 1
    pairs = [(f, before) for f in range(len(FILTERS)) for before in range(1 << len(FILTERS)) if not before >> f & 1]
    times = {b: factorial(b.bit_count()) * factorial(last - b.bit_count()) for _, b in pairs}
    every = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(b).alias("before"), F.lit(times[b]).alias("times")) for f, b in pairs]))
    rows = cells.withColumn("p", every).select("part", "mask", *_COUNTS, "p.*")
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0
    of = lambda condition, count="n": F.coalesce(F.sum(F.when(condition, F.col(count))), F.lit(0))
    done = rows.groupBy("part", "f", "before", "times").agg(
        of(passed & ~fails).alias("kept"),
        of(passed & fails).alias("removed"),
        of(~passed & fails).alias("redundant"),
        of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(passed & fails, "good").alias("good_lost"),
        of(passed & fails, "toxic").alias("toxic_lost"),
    )
    return done.withColumn("shapley", F.sum(F.col("removed") * F.col("times")).over(Window.partitionBy("part", "f")))  # 16 rows each


def orders() -> list[tuple[str, int, int, int]]:
    """Every order of the filters: (order, step, filter, filters before it as a mask)."""
    return [("".join(FILTERS[f] for f in order), k + 1, f, sum(1 << g for g in order[:k])) for order in permutations(range(len(FILTERS))) for k, f in enumerate(order)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, filter_order and step with counts of documents: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, and shapley, the sum of what the step's filter removes over all orders."""
    listed = docs.sparkSession.createDataFrame(orders(), "filter_order string, step int, f int, before int")  # 600 rows, whatever the data
    rows = effects(cells(docs, labels)).join(F.broadcast(listed), ["f", "before"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
