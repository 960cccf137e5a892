"""Dropping useless columns, imputing, log and scale transforms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col, g1_skew, numeric_columns
from cohortry.functions.moments import WIDE, Moments, column_moments
from cohortry.functions.quantiles import exact_quantiles

MAX_NULL_FRACTION = 0.5
LOG_SKEW = 2.0


def drop_duplicate_names(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Keep the first of several columns with one name."""
    seen, keep, dropped = set(), [], []
    for i, name in enumerate(df.columns):
        (dropped if name in seen else keep).append((i, name))
        seen.add(name)
    if not dropped:
        return df, []
    positional = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return positional.select(*[F.col(f"_c{i}").alias(name) for i, name in keep]), [name for _, name in dropped]


def column_quality(df: DataFrame) -> DataFrame:
    """Null fraction and constancy of every column, from one pass (extremes, not distinct counts)."""
    parts = []
    for f in df.schema.fields:
        c = col(f.name)
        comparable = c if not isinstance(f.dataType, (T.MapType, T.VariantType)) else F.to_json(c)
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.avg(c.isNull().cast("double")).alias("null_fraction"),
                F.coalesce(F.min(comparable) == F.max(comparable), F.lit(True)).alias("constant"),
            )
        )
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def cleaning_report(df: DataFrame, protect: Iterable[str] = (), max_null: float = MAX_NULL_FRACTION, drop_constant: bool = True) -> DataFrame:
    """One row per column with the reason it is dropped (null = kept)."""
    kept = F.col("column").isin(*list(protect)) if list(protect) else F.lit(False)
    missing = F.col("null_fraction")
    reason = (
        F.when(kept, None)
        .when(missing >= 1.0, "all_null")
        .when(missing > max_null, "high_null")
        .when(F.col("constant") & F.lit(drop_constant), "constant")
    )
    return column_quality(df).select("column", F.round(missing, 4).alias("null_fraction"), reason.alias("dropped_as"))


def drop_low_value_columns(df: DataFrame, protect: Iterable[str] = (), max_null: float = MAX_NULL_FRACTION, drop_constant: bool = True) -> tuple[DataFrame, dict]:
    """Project the useful columns; Catalyst then prunes the scan accordingly."""
    unique, duplicates = drop_duplicate_names(df)
    rows = cleaning_report(unique, protect, max_null, drop_constant).collect()  # one row per column
    out = {r["column"]: r["dropped_as"] for r in rows if r["dropped_as"]}
    kept = [c for c in unique.columns if c not in out]
    report = {
        "n_cols_before": len(df.columns),
        "n_cols_after": len(kept),
        "n_dropped": len(df.columns) - len(kept),
        "dropped_duplicate": duplicates,
        "dropped_all_null": [c for c, why in out.items() if why == "all_null"],
        "dropped_high_null": [(r["column"], r["null_fraction"]) for r in rows if r["dropped_as"] == "high_null"],
        "dropped_constant": [c for c, why in out.items() if why == "constant"],
    }
    return unique.select(*[col(c) for c in kept]), report


def _finite(c):
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def infinities_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    chosen = floats & set(columns) if columns is not None else floats
    return df.withColumns({c: _finite(col(c)) for c in chosen}) if chosen else df


def impute_missing(df: DataFrame, strategy: str = "median", columns: Iterable[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """Fill numeric gaps with the median, mean or zero (0 when a column is empty); infinities count as gaps."""
    names = list(columns) if columns is not None else numeric_columns(df)
    work = infinities_to_null(df, names)
    gaps = work.agg(*[F.max(col(c).isNull().cast("int")).alias(f"g{i}") for i, c in enumerate(names)]).first() if names else ()
    holed = [c for i, c in enumerate(names) if gaps[i]]
    if not holed:
        return work, {}
    if strategy == "zero":
        fills = {c: 0.0 for c in holed}
    elif strategy == "mean":
        row = work.agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(holed)]).first()
        fills = {c: row[i] for i, c in enumerate(holed)}
    else:
        fills = {c: q[0] for c, q in exact_quantiles(work, {c: [0.5] for c in holed}).items()}
    fills = {c: 0.0 if fills[c] is None else float(fills[c]) for c in holed}
    return work.withColumns({c: F.coalesce(col(c).cast("double"), F.lit(v)) for c, v in fills.items()}), fills


def sanitize(df: DataFrame, protect: Iterable[str] = (), impute: str | None = None, max_null: float = MAX_NULL_FRACTION) -> tuple[DataFrame, dict]:
    cleaned, report = drop_low_value_columns(df, protect, max_null)
    if impute:
        cleaned, fills = impute_missing(cleaned, impute)
        report["imputed"] = fills
    return cleaned, report


def clean_loaded_table(df: DataFrame, text_column: str | None = None, raw_events: bool = True) -> tuple[DataFrame, dict]:
    """Cleaning at load: row id and text column are protected; raw events are not imputed."""
    protect = [c for c in ("_row_id", text_column) if c]
    return sanitize(df, protect, impute=None if raw_events else "median")


def is_log_column(m: Moments, skew: float = LOG_SKEW) -> bool:
    return m.n > 0 and m.low >= 0 and m.skew is not None and abs(m.skew) > skew


def log_columns(df: DataFrame, columns: Iterable[str] | None = None, skew: float = LOG_SKEW) -> list[str]:
    """Non-negative columns whose bias-corrected skew exceeds the bound in size."""
    names = list(columns) if columns is not None else numeric_columns(df)
    if not names:
        return []
    if len(names) > WIDE:
        return [c for c, m in column_moments(df, names).items() if is_log_column(m, skew)]
    parts = [x for i, c in enumerate(names) for x in (F.min(col(c)).alias(f"lo{i}"), g1_skew(col(c).cast("double")).alias(f"s{i}"))]
    row = df.agg(*parts).first()
    return [c for i, c in enumerate(names) if row[f"lo{i}"] is not None and row[f"lo{i}"] >= 0 and row[f"s{i}"] is not None and abs(row[f"s{i}"]) > skew]


def log_transform(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(col(c)) for c in columns}) if columns else df


def standardise(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(x - mean) / population deviation; a column without spread keeps deviation 1."""
    names = list(columns)
    if not names:
        return df
    if len(names) > WIDE:
        return standardise_with(df, column_moments(df, names))
    parts = [x for i, c in enumerate(names) for x in (F.avg(col(c)).alias(f"m{i}"), F.stddev_pop(col(c)).alias(f"s{i}"))]
    row = df.agg(*parts).first()
    scaled = {}
    for i, c in enumerate(names):
        spread = row[f"s{i}"] or 1.0
        scaled[c] = (col(c) - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(spread))
    return df.withColumns(scaled)


def standardise_with(df: DataFrame, moments: dict[str, Moments]) -> DataFrame:
    return df.withColumns({c: (col(c).cast("double") - F.lit(m.mean)) / F.lit(m.spread) for c, m in moments.items()})


def scaled_columns(moments: dict[str, Moments], skew: float = LOG_SKEW) -> list:
    """Log-if-skewed, then standardised, as expressions: both steps from one statistics pass."""
    out = []
    for c, m in moments.items():
        if is_log_column(m, skew):
            out.append((F.log1p(col(c).cast("double")) - F.lit(m.log_mean)) / F.lit(m.log_spread))
        else:
            out.append((col(c).cast("double") - F.lit(m.mean)) / F.lit(m.spread))
    return out


def unit_rows(vectors: DataFrame, column: str = "features") -> DataFrame:
    """L2-normalise an array column; zero rows stay zero."""
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x * x))
    return vectors.withColumn("_norm", norm).withColumn(
        column, F.when(F.col("_norm") > 0, F.transform(column, lambda x: x / F.col("_norm"))).otherwise(F.col(column))
    ).drop("_norm")


def prepare_matrix(df: DataFrame, columns: Iterable[str], moments: dict[str, Moments] | None = None) -> tuple[DataFrame, list[str]]:
    """Infinities out, empty columns out, remaining gaps filled with the median."""
    names = list(columns)
    found = moments if moments is not None else column_moments(df, names)
    alive = [c for c in names if found[c].n]
    work = df.drop(*[c for c in names if c not in alive])
    holed = [c for c in alive if found[c].nulls or found[c].infinities]
    return (impute_missing(work, "median", holed)[0] if holed else work), alive
