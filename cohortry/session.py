"""Session helpers: where lineage is cut, and the checks that guard driver-side data."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Driver-side and broadcast bounds.  Anything that is collected or shipped to
# every task is checked against one of these first.
MAX_COLUMNS = 4_000  # p x p matrices on the driver
MAX_CLUSTERS = 10_000  # k rows of cluster statistics
MAX_PIVOT_VALUES = 2_000  # category values turned into columns
MAX_BLOCK_BYTES = 64 << 20  # one broadcast block of vectors


class BoundExceeded(RuntimeError):
    """A side that must stay small turned out larger than its bound."""


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named in ``spark.checkpoint.dir``; a private one only on local masters."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="cohortry-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise to reliable storage so that lost executors cannot force (or change) a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def take_bounded(df: DataFrame, bound: int, what: str) -> list:
    """Collect a table that is small by construction; raise rather than truncate when it is not."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise BoundExceeded(f"{what}: more than {bound} rows")
    return rows


def spread_out(df: DataFrame) -> DataFrame:
    """Give a heavy per-row computation at least one partition per core; only small inputs are reshuffled.

    For scans and materialised tables, whose partition count is known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
