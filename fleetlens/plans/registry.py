"""Registry of named queries and the SQL each one is checked against.

A query is registered with its output columns.  The Spark result is cast to
those types, and the check SQL is wrapped so that it selects the same columns
with the same types; adapter views named in the SQL become CTEs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.adapters import ADAPTERS
from fleetlens.sources.tables import Tables

_SPARK_TYPE = {"s": "string", "i": "bigint", "d": "double", "t": "timestamp_ntz", "b": "boolean"}
_CHECK_TYPE = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "t": "TIMESTAMP", "b": "BOOLEAN"}
_ADAPTER = re.compile(r"\b(?:from|join)\s+(\w+)", re.IGNORECASE)


@dataclass(frozen=True)
class Query:
    name: str
    columns: dict[str, str]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def shape(self, df: DataFrame) -> DataFrame:
        names = (["server_name"] if "server_name" in df.columns and "server_name" not in self.columns else [])
        return df.select(
            *names, *[F.col(c).cast(_SPARK_TYPE[t]).alias(c) for c, t in self.columns.items()]
        )

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.shape(self.build(Tables(spark, sf_dir)))

    def check_sql(self) -> str | None:
        if self.sql is None:
            return None
        needed: list[str] = []

        def visit(text: str) -> None:
            for name in _ADAPTER.findall(text):
                if name in ADAPTERS and name not in needed:
                    visit(ADAPTERS[name])
                    needed.append(name)

        visit(self.sql)
        ctes = ",\n".join(f"{n} AS ({ADAPTERS[n].strip()})" for n in needed)
        select = ", ".join(f'CAST("{c}" AS {_CHECK_TYPE[t]}) AS "{c}"' for c, t in self.columns.items())
        head = f"WITH {ctes}\n" if ctes else ""
        return f"{head}SELECT {select} FROM (\n{self.sql.strip()}\n) AS result"


QUERIES: dict[str, Query] = {}


def query(columns: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``columns`` is ``"name:type ..."``
    with types s(tring) i(nteger) d(ouble) t(imestamp) b(oolean)."""
    shape = dict(part.split(":") for part in columns.split())

    def keep(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(key, shape, fn, sql)
        return fn

    return keep


def check_ratio(a: str, b: str, scale: int) -> str:
    """Check-SQL text for whole-number ``a / b`` rounded half up at ``scale`` (non-negative)."""
    ten = 10**scale
    return (
        f"(CASE WHEN ({b}) = 0 THEN NULL ELSE ((2 * {ten} * CAST({a} AS HUGEINT) + ({b})) // (2 * ({b}))) / {ten}.0 END)"
    )
