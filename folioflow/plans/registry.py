"""A query and the SQL that must give the same rows, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale, read as they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(oracle: str | None = None):
    """Registers a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    return str(value)


def values(columns: str, rows: list[tuple]) -> str:
    """The rows as a SQL subquery; ``columns`` is a schema, of which the names are taken."""
    names = ", ".join(c.split()[0] for c in columns.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS _v({names}))"


def re2(pattern: str) -> str:
    """A rule's pattern without the flags that only one of the dialects knows, its case flag kept to itself."""
    for flags, scoped in (("(?mU)", "(?m:"), ("(?U)", "(?:"), ("(?i)", "(?i:"), ("(?m)", "(?m:")):
        if pattern.startswith(flags):
            return f"{scoped}{pattern[len(flags) :]})"
    return f"(?:{pattern})"
