"""Reading tables, giving rows an identity, and the sampling operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col, dense_index, seeded_order

PROFILE_ROWS = 50_000
MIN_DOCUMENT_CHARS = 20
PREVIEW_ROWS = 10


def load_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV or TSV by suffix; anything else is tried as parquet, then as CSV."""

    def delimited(sep: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", sep)
        return (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)

    name = path.lower().rstrip("/")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith(".csv"):
        return delimited(",")
    if name.endswith(".tsv"):
        return delimited("\t")
    try:
        return spark.read.parquet(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise
        return delimited(",")


def with_row_id(df: DataFrame, *keys: str) -> DataFrame:
    """Insert ``_row_id`` = 1..N in key order unless the table already has one."""
    return df if "_row_id" in df.columns else dense_index(df, *keys, name="_row_id")


def route(df: DataFrame, path: str | None = None, mode: str | None = None) -> tuple[str, DataFrame]:
    """Delimited files hold raw events, parquet holds finished features; a stale label column is dropped."""
    chosen = mode or ("events" if (path or "").lower().rstrip("/").endswith((".csv", ".tsv")) else "features")
    return chosen, df.drop("cluster") if chosen == "features" else df


def sample_rows(df: DataFrame, *keys: str, n: int = PROFILE_ROWS, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows by seeded hash of the key: the same rows under any partitioning.

    A hash threshold first cuts the table to slightly more than ``n`` rows, so
    the final ordered cut never sees the whole table.
    """
    total = df.count()
    if total <= n:
        return df
    mark = seeded_order(*[col(k) for k in keys], seed=seed)
    share = min(1.0, (n + 8 * math.sqrt(n) + 100) / total)
    near = df.where(mark < F.lit(int(share * 2**64) - 2**63)) if share < 1.0 else df
    if share < 1.0 and near.count() < n:  # repeated keys can make the hash uneven
        near = df
    return near.orderBy(mark, *[col(k) for k in keys]).limit(n)


def preview(df: DataFrame, *keys: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*[col(k) for k in keys]).limit(rows)


def load_corpus(documents: DataFrame, text: str = "text", min_chars: int = MIN_DOCUMENT_CHARS) -> DataFrame:
    """Documents with at least ``min_chars`` characters after trimming."""
    return documents.where(F.length(F.trim(col(text))) >= min_chars)


def benchmark_slice(documents: DataFrame, category: str, categories: list, per_category: int, *keys: str, text: str = "text", min_chars: int = 120) -> DataFrame:
    """First N sufficiently long documents of each requested category, in key order."""
    long_enough = documents.where(col(category).isin(list(categories)) & (F.length(F.trim(col(text))) >= min_chars))
    place = F.row_number().over(Window.partitionBy(col(category)).orderBy(*[col(k) for k in keys]))
    return long_enough.withColumn("_place", place).where(F.col("_place") <= per_category).drop("_place")
