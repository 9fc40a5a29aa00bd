"""Named queries and their DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_MODULES = ("rows", "segments", "models")
_TYPES = {"i": ("BIGINT", "long"), "d": ("DOUBLE", "double"), "s": ("VARCHAR", "string"), "b": ("BOOLEAN", "boolean")}


def query(columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name.

    columns: "name:type ..." of its result, with i, d, s, b for integers, doubles (rounded to
    six decimals), strings and booleans; the SQL's last select is made of them too.
    """
    named = [c.split(":") for c in columns.split()]

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = [F.col(c).cast(_TYPES[t][1]) for c, t in named]
            return f(spark, sf_dir).select(*((F.round(x, 6) + 0.0 if t == "d" else x).alias(c) for x, (c, t) in zip(out, named)))

        _QUERIES[f.__name__] = run
        if sql is not None:
            picked = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) + 0.0::DOUBLE AS "{c}"' if t == "d" else f'CAST("{c}" AS {_TYPES[t][0]}) AS "{c}"' for c, t in named)
            _SQL[f.__name__] = f"WITH {sql.strip()} SELECT {picked} FROM q"
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"voltrail.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
