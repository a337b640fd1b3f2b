"""Tables of an SQLite file as a Spark data source, read in parts.

    sqlite(spark).schema("q string, source string").option("table", "questions").load("/shared/log.db")

The rows are cut by ranges of SQLite's row numbers, so that a large table is many tasks; only the columns of the schema are
selected; and comparisons, null tests and lists of values are put into the statement.  The file must lie where all executors can
open it, and is opened to read only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from urllib.parse import quote

from pyspark.sql import DataFrameReader, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

ROWS = 1_000_000  # row numbers in a part, about

_TYPES = {"INT": "bigint", "CHAR": "string", "CLOB": "string", "TEXT": "string", "REAL": "double", "FLOA": "double", "DOUB": "double", "BLOB": "binary"}
_CASTS = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.DoubleType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _opened(path: str):
    return closing(sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True))


def sqlite(spark: SparkSession) -> DataFrameReader:
    """A reader of this format; Spark takes sources that push filters down only where its session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite")


class SqliteSource(ds.DataSource):
    """Options: ``path``, ``table``, and ``rows``, how many row numbers a part has."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with _opened(self.options["path"]) as db:
            found = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"there is no table {self.options['table']!r}")
        kind = lambda declared: next((t for k, t in _TYPES.items() if k in declared.upper()), "string")
        return ", ".join(f"`{name}` {kind(declared)}" for _, name, declared, *_ in found)

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.kinds = {f.name: _CASTS.get(type(f.dataType)) for f in schema.fields}
        for name, kind in self.kinds.items():
            if kind is None:
                raise ValueError(f"column {name}: whole numbers, doubles, strings and bytes can be read")
        self.tests: list[str] = []
        self.values: list = []

    def _cell(self, name: str) -> str:
        return f"CAST({_name(name)} AS {self.kinds[name]})"

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in self.kinds:
                yield f
            elif type(f) in _COMPARED and isinstance(f.value, (int, float, str)):
                self.tests.append(f"{self._cell(name)} {_COMPARED[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, ds.In) and all(isinstance(v, (int, float, str)) for v in f.value):
                self.tests.append(f"{self._cell(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (ds.IsNotNull, ds.IsNull)):
                self.tests.append(f"{_name(name)} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        with _opened(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        return [ds.InputPartition((a, min(a + self.rows - 1, high))) for a in range(low, high + 1, self.rows)] if low is not None else [ds.InputPartition((1, 0))]

    def read(self, partition: ds.InputPartition) -> Iterator[tuple]:
        cells = ", ".join(map(self._cell, self.kinds)) or "1"
        tests = " AND ".join(["rowid BETWEEN ? AND ?", *self.tests])
        with _opened(self.path) as db:
            for row in db.execute(f"SELECT {cells} FROM {_name(self.table)} WHERE {tests}", (*partition.value, *self.values)):
                yield row if self.kinds else ()
