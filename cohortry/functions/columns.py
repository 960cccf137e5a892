"""Column expressions that Spark does not ship in the form needed here."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.session import cut_lineage, take_bounded


def col(name: str) -> Column:
    """Reference a column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in skip]


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def g1_skew(x: Column) -> Column:
    """Bias-corrected sample skewness: null under three values, 0 without spread."""
    n = F.count(x)
    factor = F.sqrt(n * (n - 1.0)) / (n - 2.0)
    return F.when(n < 3, F.lit(None).cast("double")).when(F.stddev_pop(x) == 0, F.lit(0.0)).otherwise(F.skewness(x) * factor)


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants, independent of the session zone."""
    return F.extract(F.lit("DAYS"), later - earlier).cast("long")


def month_index(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def seeded_order(*keys: Column, seed: int = 42) -> Column:
    """A pseudo-random but partition-independent ordering value."""
    return F.xxhash64(*keys, F.lit(seed))


def safe_name(value: object) -> str:
    """Feature names may only hold letters, digits and underscores."""
    return re.sub(r"[^0-9A-Za-z_]", "_", str(value))


def unique_names(values: Iterable[object]) -> dict[object, str]:
    """Map values to safe names, numbering the ones that collide."""
    out: dict[object, str] = {}
    seen: dict[str, int] = {}
    for v in values:
        base = safe_name(v)
        seen[base] = seen.get(base, 0) + 1
        out[v] = base if seen[base] == 1 else f"{base}__{seen[base]}"
    return out


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens (0 for blank text)."""
    body = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(body) == 0, F.lit(0)).otherwise(F.size(F.split(body, " ")))


def min_max_scaled(x: Column, constant: float = 0.5, ascending: bool = True) -> Column:
    """Min-max over the whole (small) table; ``constant`` when there is no spread."""
    w = Window.partitionBy(F.lit(1))
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    up = (x - lo) / (hi - lo) if ascending else (hi - x) / (hi - lo)
    return F.when(hi - lo < 1e-12, F.lit(float(constant))).otherwise(up)


def dense_index(df: DataFrame, *keys: str, name: str = "_row_id", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Contiguous 1..N row numbers in key order without sorting in a single task.

    Range-partition on the key, number rows inside each partition, then add the
    partition's offset.  The ranged rows are checkpointed first: offsets and
    positions must come from the same partitioning even after a task is lost.
    """
    order = [F.col(k) for k in keys]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn("_slot", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_slot"), 33)
    sizes = placed.groupBy(part.alias("p")).count()
    offsets, running = {}, 0
    for row in sorted(take_bounded(sizes, 1_000_000, "partitions"), key=lambda r: r["p"]):
        offsets[row["p"]] = running
        running += row["count"]
    if not offsets:
        return df.withColumn(name, F.lit(None).cast("long")).select(name, *df.columns)
    spark = df.sparkSession
    table = spark.createDataFrame(list(offsets.items()), "_part long, _offset long")
    local = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_offset") + local + F.lit(start))
        .select(name, *df.columns)
    )
