"""Catalogue of queries: a DataFrame over the warehouse tables and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.cte import with_ctes
from barloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    doubles: dict[str, int]

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        """Result with floating columns fixed to the compared number of digits."""
        df = self.build(Tables(spark, path))
        return df.select(*[(F.round(F.col(c), self.doubles[c]) + 0.0).alias(c) if c in self.doubles else F.col(c) for c in df.columns])

    def oracle(self) -> str | None:
        if self.sql is None or not self.doubles:
            return self.sql
        fixed = ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in self.doubles.items())
        return f"SELECT * REPLACE ({fixed}) FROM (\n{self.sql}\n)"


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ctes: str = "", doubles: str = "") -> Callable:
    """Register a query. ``doubles`` lists floating columns, ``name:digits`` (8 by default)."""
    digits = {}
    for item in doubles.split():
        col, _, d = item.partition(":")
        digits[col] = int(d or 8)

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CATALOGUE:
            raise ValueError(f"duplicate query {name}")
        CATALOGUE[name] = Query(name, build, with_ctes(sql, ctes) if sql else None, digits)
        return build

    return wrap
