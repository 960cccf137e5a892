"""Exact quantiles that never hold a column, or a hot group, in one task.

Spark's ``percentile`` keeps a value -> count map for each group in one task.
That is right for ordinary groups; for a whole table, or for a key that owns a
large share of the rows, the wanted ranks are located by counting into buckets
first, and only the bucket that holds them is examined value by value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col
from cohortry.session import cut_lineage

BUCKETS = 4_096
ONE_PASS_ROWS = 5_000_000
HOT_GROUP_ROWS = 2_000_000
WINDOW_ROWS = 100_000


def exact_quantiles(
    df: DataFrame, wanted: dict[str, list[float]], one_pass_rows: int = ONE_PASS_ROWS
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of whole columns, as driver-side floats."""
    if not wanted:
        return {}
    sizes = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(wanted)]).first()
    small, out = {}, {}
    for i, (c, probs) in enumerate(wanted.items()):
        if sizes[i] == 0:
            out[c] = [None] * len(probs)
        elif sizes[i] <= one_pass_rows:
            small[c] = probs
        else:
            out[c] = _refined(df.select(col(c).cast("double").alias("x")).where("x is not null"), sizes[i], probs)
    if small:
        row = df.agg(
            *[F.percentile(col(c), F.array(*[F.lit(float(p)) for p in ps])).alias(f"q{i}") for i, (c, ps) in enumerate(small.items())]
        ).first()
        out.update({c: list(row[i]) for i, c in enumerate(small)})
    return out


def _refined(x: DataFrame, n: int, probs: list[float]) -> list[float]:
    ends = x.agg(F.min("x"), F.max("x")).first()
    cache: dict[int, float] = {}

    def order_statistic(rank: int) -> float:
        if rank not in cache:
            cache[rank] = _nth(x, rank, ends[0], ends[1])
        return cache[rank]

    out = []
    for p in probs:
        place = p * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        a = order_statistic(low)
        b = a if high == low else order_statistic(high)
        out.append(a + (b - a) * (place - low))
    return out


def _nth(x: DataFrame, rank: int, lo: float, hi: float) -> float:
    """The value at 0-based ``rank``: narrow [lo, hi] by bucket counts until few distinct values remain."""
    while hi > lo:
        width = (hi - lo) / BUCKETS
        inside = F.col("x").between(lo, hi)
        if width == 0 or lo + width == lo:
            break
        bucket = F.when(inside, F.least(F.floor((F.col("x") - lo) / width), F.lit(BUCKETS - 1)))
        counts = {
            r["b"]: r["n"]
            for r in x.where(F.col("x") <= hi).groupBy(F.coalesce(bucket, F.lit(-1)).alias("b")).agg(F.count("*").alias("n")).collect()
        }
        below = counts.pop(-1, 0)
        chosen = max(counts)
        for b in sorted(counts):
            if rank < below + counts[b]:
                chosen = b
                break
            below += counts[b]
        new_lo, new_hi = max(lo, lo + (chosen - 1) * width), min(hi, lo + (chosen + 2) * width)
        if new_hi - new_lo >= hi - lo or sum(counts.get(chosen + d, 0) for d in (-1, 0, 1)) <= 100_000:
            lo, hi = new_lo, new_hi
            break
        lo, hi = new_lo, new_hi
    seen = x.where(F.col("x") < lo).count()
    values = x.where(F.col("x").between(lo, hi)).groupBy("x").count().orderBy("x")
    for r in values.toLocalIterator():
        seen += r["count"]
        if rank < seen:
            return r["x"]
    return hi


def group_medians(
    df: DataFrame, keys: list[str], values: dict[str, str], hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Exact median per group for several value columns (``{output: input}``).

    Groups above ``hot_rows`` rows are split by value bucket, the bucket holding
    the middle ranks is found from counts, and only that bucket is resolved.
    """
    plain = [F.percentile(col(v), F.lit(0.5)).alias(o) for o, v in values.items()]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = sizes.where(F.col("_n") > hot_rows).select(*keys)
    if hot.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    marks = hot.toDF(*[f"_h_{k}" for k in keys])  # at most rows / hot_rows groups
    cold = df.join(F.broadcast(marks), same, "left_anti").groupBy(*keys).agg(*plain)
    hot_rows_df = df.join(F.broadcast(marks), same, "left_semi")
    result = None
    for out, src in values.items():
        one = _hot_medians(hot_rows_df, keys, src).withColumnRenamed("_median", out)
        result = one if result is None else result.join(one, keys, "full")
    return cold.unionByName(result)


def _hot_medians(df: DataFrame, keys: list[str], value: str, window_rows: int | None = None) -> DataFrame:
    """Medians of few large groups, each between two values that close in on its middle ranks.

    A round counts the values between them into buckets and goes on with the bucket that holds the rank; the ends of a
    range never share a bucket, so every round shrinks it. Ranges of ``window_rows`` rows at most are sorted.
    """
    limit = WINDOW_ROWS if window_rows is None else window_rows
    x = df.select(*keys, col(value).cast("double").alias("_x")).where("_x is not null")
    ends = x.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count("_x").alias("_n"))
    rank = F.explode(F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))).alias("_rank")
    targets = cut_lineage(ends.select(*keys, rank, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_c")))
    inside = F.col("_x").between(F.col("_lo"), F.col("_hi"))
    upto = Window.partitionBy(*keys, "_rank").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    while not targets.where((F.col("_c") > limit) & (F.col("_lo") < F.col("_hi"))).isEmpty():
        placed = x.join(F.broadcast(targets.drop("_c")), keys).where(inside)  # two targets per hot group
        share = (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        bucket = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
        hist = placed.groupBy(*keys, "_rank", "_below", bucket.cast("int").alias("_b")).agg(F.count("*").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        summed = hist.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        holds = (F.col("_rank") >= F.col("_below")) & (F.col("_rank") < F.col("_below") + F.col("_c"))
        targets = cut_lineage(summed.where(holds).select(*keys, "_rank", "_lo", "_hi", "_below", "_c"))
    counts = x.join(F.broadcast(targets.drop("_c")), keys).where(inside).groupBy(*keys, "_rank", "_below", "_x").agg(F.count("*").alias("_c"))
    running = Window.partitionBy(*keys, "_rank").orderBy("_x")
    located = counts.withColumn("_end", F.col("_below") + F.sum("_c").over(running)).where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_c")))
    resolved = located.groupBy(*keys).agg(F.avg("_x").alias("_median"))
    return df.select(*keys).distinct().join(resolved, keys, "left")
