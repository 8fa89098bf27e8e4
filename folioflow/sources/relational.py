"""Tables of SQLite files as a Spark source: read by ranges of row ids, with filters and columns' types taken from the table.

    session.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", file).option("table", name).load()

Filters go to the file where SQLite gives them the meaning that Spark does; wanted is ``spark.sql.python.filterPushdown.enabled``. The file must be
readable at its path by every executor. It is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import datasource as ds
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

#: Rows of a batch, and of a partition at least.
BATCH, LEAST_ROWS = 4096, 1024
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_KIND = {"long": "integer", "double": "real", "string": "text", "binary": "blob"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file:'))}?mode=ro", uri=True)


def _type(declared: str):
    """The column's type by SQLite's rules of affinity; what may be anything is read as text."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return StringType()
    if "BLOB" in d:
        return BinaryType()
    return DoubleType() if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")) else StringType()


@dataclass
class Rows(ds.InputPartition):
    """Row ids from low to high, both included."""

    low: int
    high: int


class SqliteSource(ds.DataSource):
    """Options: path, table, and partitions (8). The table must have row ids."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with opened(self.options["path"]) as con:
            found = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        con.close()
        if not found:
            raise ValueError(f"no table {self.options['table']}")
        return StructType([StructField(name, _type(kind)) for _, name, kind, *_ in found])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(dict(self.options), schema)


class SqliteReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.fields = options, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        types = {f.name: f.dataType.simpleString() for f in self.fields}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = types.get(column)
            # a value of another storage class would be compared by class, not by value
            sound = f"typeof({_quoted(column)}) IN ('{ {'bigint': 'integer', 'double': 'real', 'string': 'text'}.get(kind, '') }')" if column else ""
            if column and type(f) in _COMPARED and kind in ("bigint", "string"):
                self.where.append(f"({sound} AND {_quoted(column)} {_COMPARED[type(f)]} ?)")
                self.values.append(f.value)
            elif column and isinstance(f, ds.In) and kind in ("bigint", "string") and len(f.value) <= 500:
                self.where.append(f"({sound} AND {_quoted(column)} IN ({', '.join('?' * len(f.value))}))")
                self.values += f.value
            elif column and isinstance(f, ds.StringContains) and kind == "string":
                self.where.append(f"({sound} AND instr({_quoted(column)}, ?) > 0)")
                self.values.append(f.value)
            elif column and isinstance(f, ds.IsNotNull):
                self.where.append(f"{_quoted(column)} IS NOT NULL")
                yield f  # a value that cannot be read as the column's type becomes null
            else:
                yield f

    def partitions(self) -> list[Rows]:
        con = opened(self.options["path"])
        try:
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.options['table'])}").fetchone()
        finally:
            con.close()
        if low is None:  # one partition that holds nothing
            return [Rows(1, 0)]
        n = max(1, min(int(self.options.get("partitions", 8)), (high - low) // LEAST_ROWS + 1))
        step = -(-(high - low + 1) // n)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def sql(self) -> str:
        columns = ", ".join(_quoted(f.name) for f in self.fields)
        return f"SELECT {columns} FROM {_quoted(self.options['table'])} WHERE " + " AND ".join(["rowid BETWEEN ? AND ?", *self.where])

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        con = opened(self.options["path"])
        con.text_factory = lambda raw: raw.decode("utf-8", "replace")
        kinds = [f.dataType.typeName() for f in self.fields]
        types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        try:
            cursor = con.execute(self.sql(), (partition.low, partition.high, *self.values))
            while rows := cursor.fetchmany(BATCH):
                columns = [pa.array([_read(v, k) for v in c], types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=self.fields.names)
        finally:
            con.close()


def _read(value, kind: str):
    """A stored value as the column's type: SQLite keeps any value in any column."""
    if value is None:
        return None
    if kind == "string":
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    if kind == "binary":
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(value, (int, float)):
        return float(value) if kind == "double" else int(value) if value == int(value) else None
    return None
