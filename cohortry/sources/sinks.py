"""Writers for matrices, labels, reports and per-iteration snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col, g1_skew, numeric_columns

PREVIEW_ROWS = 8
PREVIEW_KEPT = 20


def save_matrix(matrix: DataFrame, path: str) -> None:
    matrix.write.mode("overwrite").parquet(path)


def save_labels(labels: DataFrame, path: str, key: str = "entity_id") -> None:
    """``row_index, cluster_id`` as CSV, written by the executors."""
    labels.select(col(key).alias("row_index"), F.col("cluster_id").cast("int")).write.mode("overwrite").option("header", True).csv(path)


def report_rows(profiles: DataFrame, personas: DataFrame, importances: DataFrame | None = None) -> DataFrame:
    """Profiles with their personas (left join on the cluster), one JSON document per cluster."""
    body = profiles.join(personas.withColumnRenamed("cluster_id", "_cid"), col("cluster_id") == col("_cid"), "left")
    persona = [c for c in personas.columns if c != "cluster_id"]
    stats = [c for c in profiles.columns if c != "cluster_id"]
    return body.select(
        "cluster_id", F.to_json(F.struct(F.struct(*stats).alias("cluster_stats"), F.struct(*persona).alias("persona"))).alias("document")
    )


def top_importances(importances: DataFrame, n: int = 20) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_snapshot(df: DataFrame, path: str, iteration: int) -> None:
    """One folder per iteration; a repeated iteration replaces only its own folder."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/iteration={iteration}")


def read_snapshots(spark, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/iteration=*")


def stage_preview(df: DataFrame, stage: str, iteration: int, *keys: str, rows: int = PREVIEW_ROWS) -> DataFrame:
    """One row per column: missing percentage and skew, with the first values in key order."""
    numbers = set(numeric_columns(df))
    names = df.columns
    order = F.struct(*[col(k) for k in keys])
    parts = []
    for c in names:
        x = col(c).cast("double") if c in numbers else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.round(F.avg(col(c).isNull().cast("double")) * 100, 2).alias("missing_pct"),
                F.round(g1_skew(x), 3).alias("skew"),
            )
        )
    stats = df.agg(F.array(*parts).alias("a"), F.count("*").alias("n_rows")).select("n_rows", F.explode("a").alias("s")).select("n_rows", "s.*")
    head = df.orderBy(order).limit(rows).agg(F.array(*[F.struct(F.lit(c).alias("column"), F.collect_list(col(c).cast("string")).alias("head")) for c in names]).alias("h"))
    heads = head.select(F.explode("h").alias("x")).select("x.*")
    return stats.join(heads, "column").select(
        F.lit(stage).alias("stage"), F.lit(iteration).alias("iteration"), "column", "n_rows", "missing_pct", "skew", "head"
    )


def upsert_previews(existing: DataFrame, fresh: DataFrame, keep: int = PREVIEW_KEPT) -> DataFrame:
    """Replace snapshots of the same (stage, iteration) and keep the most recent ``keep`` of them.

    Both tables carry ``seq``, the order in which snapshots were taken.
    """
    key = ["stage", "iteration"]
    merged = existing.join(fresh.select(*key).distinct(), key, "left_anti").unionByName(fresh)
    latest = merged.select(*key, "seq").distinct()
    ranked = latest.withColumn("_place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("seq"))))
    return merged.join(ranked.where(F.col("_place") <= keep).select(*key), key, "left_semi")
