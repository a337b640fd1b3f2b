"""Running values over a whole table without sending it to one task.

Rows are sorted by ranges of all the columns that order them, so that equal values of the first are told apart by the others and no
value's rows are one task's.  A range has about as many bytes as Spark gives a task.  In a range a column is added up as
it streams by; of each range a row of totals is added up over the ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolake.storage import checkpointed


RANGES = 200  # at most
LEAST_ROWS = 25_000  # of a range, about


def ranges(df: DataFrame, column: str, parts: int = RANGES, least: int = LEAST_ROWS) -> Column:
    """The number of the range that a row's ``column`` (a number or a timestamp) falls in, of at most ``parts`` with about as many
    rows each, and about ``least`` at least.

    The borders are approximate quantiles, so no range grows with how rows crowd in time; a value that is a
    third of all rows is a range by itself.  Null comes first, as it sorts.
    """
    x = F.unix_micros(F.col(column).cast("timestamp")) if dict(df.dtypes)[column].startswith("timestamp") else F.col(column).cast("double")
    n, cuts = df.agg(F.count("*"), F.percentile_approx(x.cast("double"), [k / parts for k in range(1, parts)], 10 * parts)).first()
    step = -(-parts // max(1, min(parts, n // least)))
    cuts = sorted(set((cuts or [])[step - 1 :: step]))
    if not cuts:
        return F.lit(0)
    # a search by halves in nested conditions, made by code generation

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x.cast("double") > cuts[mid], place(mid + 1, hi)).otherwise(place(lo, mid))

    return place(0, len(cuts))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """``df`` with the sum of each of ``sums`` over all rows up to and including this one in ``order``.

    Sums are whole numbers (64 bits) or doubles; null adds nothing.  Rows that are equal in ``order`` come in any order.  The table is
    shuffled once and stored; the totals, a row a range, are broadcast.  Where ranges are known already, a ``bucket``, which must not fall
    as ``order`` rises (a time slice, say), takes the place of the sort by ranges, and nothing is stored.
    """
    return _by_sort(df, order, sums) if bucket is None else _by_bucket(df, order, sums, bucket)


def _by_bucket(df: DataFrame, order: list[str], sums: dict[str, Column], bucket: Column) -> DataFrame:
    rows = df.withColumn("_bucket", bucket).withColumns({f"_v_{n}": c for n, c in sums.items()})
    whole = rows.groupBy("_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums}).join(starts, "_bucket")
    return got.select(*df.columns, *[(F.coalesce(F.col(f"_r_{n}"), F.lit(0)) + F.col(f"_s_{n}")).alias(n) for n in sums])


def _by_sort(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    columns, names = df.columns, list(sums)
    values = df.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    kinds = {n: "double" if values.schema[f"_v_{n}"].dataType.typeName() in ("double", "float", "decimal") else "bigint" for n in names}
    rows = values.withColumns({f"_v_{n}": F.coalesce(F.col(f"_v_{n}").cast(t), F.lit(0).cast(t)) for n, t in kinds.items()})
    schema = rows.withColumns({"_range": F.lit(0), "_at": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at, reached = TaskContext.get().partitionId(), 0, [0] * len(names)
        for b in batches:
            made = []
            for k in range(len(names)):
                x = b.column(len(columns) + k).to_numpy()
                total = np.cumsum(np.concatenate([np.array(reached[k : k + 1], dtype=x.dtype), x]))[1:]
                reached[k] = total[-1] if len(total) else reached[k]
                made.append(pa.array(total))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], *made, pa.array(np.full(n, number, dtype=np.int32)), pa.array(np.arange(at, at + n))], names=schema.names)
            at += n

    stored = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema))
    totals = stored.groupBy("_range").agg(F.max_by(F.struct(*[f"_v_{n}" for n in names]), "_at").alias("t"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"t._v_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in names])
    got = stored.join(F.broadcast(starts), "_range")
    return got.select(*columns, *[(F.col(f"_v_{n}") + F.col(f"_s_{n}")).alias(n) for n in names])


def positions(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``df`` with the place of each row in its group, from 0 in ``order``; a group may be of any size.

    A group's first row tells what came before it: one row a group is joined.
    """
    got = running_sums(df, [*by, *order], {name: F.lit(1)})
    first = got.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)]).agg(F.min(name).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)]
    joined = got.join(first, same) if by else got.crossJoin(F.broadcast(first))  # one row
    return joined.select(*df.columns, (F.col(name) - F.col("_first")).alias(name))
