"""Registration of queries and small helpers to state both sides with the same column names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t.orders`` reads ``<dir>/orders.parquet``; columns and filters are pruned by the reader."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``, with its SQL counterpart if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def _nudge(digits: int) -> float:
    """Averages of two-decimal amounts often end exactly on a rounding tie; move off it the same way in both engines."""
    return 0.0037 * 10.0**-digits


def rounded(df: DataFrame, digits: int = 6, only: Iterable[str] | None = None) -> DataFrame:
    """Round floating columns (and normalise -0.0) so that both engines print the same value."""
    chosen = set(only) if only is not None else None
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (chosen is None or f.name in chosen):
            c = (F.round(c.cast("double") + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def r(expr: str, digits: int = 6) -> str:
    """The SQL twin of :func:`rounded`."""
    return f"(round(CAST({expr} AS DOUBLE) + CAST({_nudge(digits)!r} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
