"""Small tables written out in place, the same for Spark and for SQL: inputs of queries whose input no adapter view has, and results that SQL can't compute."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TYPES = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def value(v, kind: str) -> str:
    if kind.startswith("array<"):
        return "NULL" if v is None else f"CAST([{', '.join(value(x, kind[6:-1]) for x in v)}] AS {TYPES[kind[6:-1]]}[])"
    text = "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"CAST({text} AS {TYPES[kind]})"


@dataclass(frozen=True)
class Literal:
    rows: tuple
    schema: str

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([list(r) for r in self.rows], self.schema)

    def select(self) -> str:
        """SQL with the rows as they are."""
        names = ", ".join(n for n, _ in self.columns)
        rows = ", ".join("(" + ", ".join(value(v, k) for v, (_, k) in zip(r, self.columns, strict=True)) + ")" for r in self.rows)
        return f"SELECT * FROM (VALUES {rows}) t({names})"

    def cte(self, name: str) -> str:
        return f"{name} AS ({self.select()})"
