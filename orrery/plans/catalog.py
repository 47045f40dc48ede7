"""Registry of named queries: a callable over (spark, sf_dir), and SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def templates() -> list[str]:
    """Names of the queries that have SQL."""
    return sorted(SQL)


def template(name: str) -> str:
    """SQL of a query, to run over tables of the same names elsewhere."""
    if name not in SQL:
        raise KeyError(f"no SQL for {name}")
    return SQL[name]


def rounded(df: DataFrame, keys: tuple[str, ...] = ("cohort", "signal_id", "k"), digits: int = 6) -> DataFrame:
    """Every column but the keys as DOUBLE, rounded."""
    return df.select(*keys, *(F.round(F.col(c).cast("double"), digits).alias(c) for c in df.columns if c not in keys))
