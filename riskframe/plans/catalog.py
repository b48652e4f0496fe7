"""Registry of named queries: Spark plan + DuckDB oracle SQL (or none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``oracle`` is the equivalent DuckDB SQL over the driver views; ``None``
    marks a query SQL cannot express (checked by our own tests instead).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def edge(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns at the output edge, so floating summation order
    cannot change the compared value (the oracle rounds the same way)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(expr: str, name: str | None = None) -> str:
    """SQL twin of ``edge`` for one oracle column."""
    return f"ROUND(CAST({expr} AS DOUBLE), 6) AS {name or expr}"
