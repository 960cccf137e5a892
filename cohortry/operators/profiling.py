"""Column profile, text-column detection, and the rule tables that read them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col, g1_skew, is_temporal, numeric_columns, string_columns, token_count
from cohortry.functions.moments import column_moments
from cohortry.functions.partials import PART_SCHEMA, matrix_parts, summed_rows
from cohortry.functions.quantiles import exact_quantiles

EXACT_DISTINCT_UP_TO = 1_000
HIGH_MISSING = 0.30
HIGH_CARDINALITY = 100


def distinct_counts(df: DataFrame, columns: list[str], exact_up_to: int = EXACT_DISTINCT_UP_TO) -> dict[str, int]:
    """Distinct non-null values: a sketch for every column, exact where the sketch says there are few.

    All the decisions taken on these counts lie far below ``exact_up_to``, so
    the sketch error never changes one.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    out = {c: int(sketch[i]) for i, c in enumerate(columns)}
    few = [c for c in columns if out[c] <= exact_up_to]
    if few:
        exact = df.agg(*[F.size(F.collect_set(col(c))).alias(f"d{i}") for i, c in enumerate(few)]).first()
        out.update({c: int(exact[i]) for i, c in enumerate(few)})
    return out


def exact_distinct(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct non-null values of each column, counted in one pass over (column, hash of the value) pairs."""
    if not columns:
        return {}
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.xxhash64(col(c)).alias("h"), col(c).isNotNull().alias("ok")) for i, c in enumerate(columns)])).alias("s"))
    found = {r["c"]: r["n"] for r in pairs.where("s.ok").select("s.c", "s.h").distinct().groupBy("c").count().withColumnRenamed("count", "n").collect()}  # a row per column
    return {c: int(found.get(i, 0)) for i, c in enumerate(columns)}


def column_types(df: DataFrame, distinct: dict[str, int] | None = None) -> dict[str, str]:
    """numeric, then datetime, then binary (one or two values), then categorical, else other."""
    rest = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.NumericType) and not is_temporal(f.dataType)]
    countable = [c for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    counts = distinct if distinct is not None else distinct_counts(df, countable)
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        elif is_temporal(f.dataType):
            out[f.name] = "datetime"
        elif 1 <= counts.get(f.name, 3) <= 2:
            out[f.name] = "binary"
        elif isinstance(f.dataType, (T.StringType, T.CharType, T.VarcharType)):
            out[f.name] = "categorical"
        else:
            out[f.name] = "other"
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: kind, missing rate and flags, and the distribution of numeric columns.

    One pass gives the moments of all numeric columns.  As in the rest of the
    profile, NaN counts as missing.
    """
    kinds = column_types(df)
    texts = [c for c, k in kinds.items() if k == "categorical"]
    cards = distinct_counts(df, texts)
    numbers = numeric_columns(df)
    found = column_moments(df, numbers)
    others = [c for c in df.columns if c not in found]
    gaps = df.agg(F.count("*").alias("n"), *[F.count(F.when(col(c).isNull(), 1)).alias(f"g{i}") for i, c in enumerate(others)]).first()
    rows = []
    for name in df.columns:
        m = found.get(name)
        missing = (m.nulls if m else gaps[f"g{others.index(name)}"]) / max(gaps["n"], 1)
        numbers_of = (None,) * 5
        if m and m.n:
            std = math.sqrt(m.variance * m.n / (m.n - 1)) if m.n > 1 else None
            numbers_of = (m.low, m.high, m.mean, std, m.skew)
        rows.append((name, kinds[name], float(missing), *numbers_of, cards.get(name, 0) > HIGH_CARDINALITY))
    schema = "column string, kind string, missing double, min double, max double, mean double, std double, skewness double, high_cardinality boolean"
    long = df.sparkSession.createDataFrame(rows, schema)  # one row per column
    missing = F.round("missing", 4)
    return long.select(
        "column",
        "kind",
        missing.alias("missing"),
        (missing > HIGH_MISSING).alias("high_missing"),
        *[F.round(n, 4).alias(n) for n in ("min", "max", "mean", "std", "skewness")],
        "high_cardinality",
    )


def profile_hints(profile: DataFrame, modality: str = "tabular") -> DataFrame:
    """Mean absolute skew over the profile, the algorithm it suggests, and the warnings."""
    skew = F.coalesce(F.avg(F.abs("skewness")), F.lit(0.0))
    numeric = F.count(F.when(F.col("kind") == "numeric", 1))
    base = profile.agg(
        skew.alias("mean_abs_skew"),
        numeric.alias("n_numeric"),
        F.count(F.when(F.col("high_missing"), 1)).alias("n_high_missing"),
        F.count(F.when(F.col("high_cardinality"), 1)).alias("n_high_cardinality"),
    )
    s = F.col("mean_abs_skew")
    return base.select(
        "mean_abs_skew",
        F.when(s > 2.0, "hierarchical").when(s < 0.5, "kmeans").otherwise("hierarchical").alias("hint"),
        F.array_compact(
            F.array(
                F.when(F.col("n_high_missing") > 0, "high_missing"),
                F.when(F.col("n_high_cardinality") > 0, "high_cardinality"),
                F.when((F.col("n_numeric") < 5) & F.lit(modality == "tabular"), "few_numeric"),
                F.when(s > 3.0, "high_skew"),
            )
        ).alias("warnings"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the extremes, the last one closed; empty bins are kept."""
    x = col(column).cast("double")
    values = df.select(x.alias("x")).where("x is not null and not isnan(x)")
    ends = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    lo, hi = float(ends["lo"]), float(ends["hi"])
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("low"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("high"),
    )
    return edges.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, maximum, mean, exact median and population deviation of one column."""
    middle = exact_quantiles(df, {column: [0.5]})[column][0]
    x = col(column).cast("double")
    return df.agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.lit(middle).cast("double").alias("median"),
        F.stddev_pop(x).alias("std"),
    )


# ---------------------------------------------------------------------------
# text columns and modality
# ---------------------------------------------------------------------------


def text_scores(df: DataFrame) -> DataFrame:
    """Tokens per value, uniqueness and score of each string column over all rows."""
    texts = string_columns(df)
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, avg_tokens double, uniqueness double, score double")
    distinct = exact_distinct(df, texts)
    per = []
    for i, c in enumerate(texts):
        v = col(c)
        per.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(i).alias("position"),
                F.avg(F.when(v.isNotNull(), token_count(v))).alias("avg_tokens"),
                (F.lit(distinct[c]) / F.greatest(F.count(v), F.lit(1))).alias("uniqueness"),
                F.count(v).alias("n"),
            )
        )
    long = df.agg(F.array(*per).alias("a")).select(F.explode("a").alias("s")).select("s.*").where("n > 0")
    return long.withColumn("score", F.col("avg_tokens") * (0.5 + 0.5 * F.col("uniqueness")))


def detect_text_column(scores: DataFrame, min_tokens: float = 8.0, min_uniqueness: float = 0.5) -> str | None:
    """The best-scoring free-text column (the first one on ties); thresholds 5 / 0 give the looser variant."""
    best = scores.where((F.col("avg_tokens") >= min_tokens) & (F.col("uniqueness") >= min_uniqueness) & (F.col("score") > 0))
    row = best.orderBy(F.desc("score"), "position").first()
    return row["column"] if row else None


def route_modality(df: DataFrame, forced: str | None = None) -> dict:
    """Text when forced or when a free-text column is found; tabular data needs a numeric column."""
    if df.isEmpty():
        return {"modality": forced or "tabular", "text_column": None, "blocked": True, "reason": "Dataset is empty."}
    text = None if forced == "tabular" else detect_text_column(text_scores(df))
    modality = forced or ("text" if text else "tabular")
    if modality == "tabular" and not numeric_columns(df):
        return {"modality": modality, "text_column": None, "blocked": True, "reason": "No numeric columns found."}
    return {"modality": modality, "text_column": text, "blocked": False, "reason": ""}


def grouping_columns(df: DataFrame, low: int = 2, high: int = 200) -> DataFrame:
    """String columns with 2..200 values, with their sorted values."""
    texts = string_columns(df)
    counts = distinct_counts(df, texts)
    picked = [c for c in texts if low <= counts[c] <= high]
    if not picked:
        return df.sparkSession.createDataFrame([], "column string, values array<string>")
    found = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.sort_array(F.collect_set(col(c))).alias("values")) for c in picked]).alias("a"))
    return found.select(F.explode("a").alias("s")).select("s.*")


# ---------------------------------------------------------------------------
# decisions read off the profile
# ---------------------------------------------------------------------------


def control_gates(n_rows: int, mean_skew: float, modality: str = "tabular", max_pct: float | None = None, **overrides) -> dict:
    """Cluster-size cap, sub-cluster count and split depth from size and skew; overrides are clamped."""
    if n_rows < 1_000 or modality == "text":
        pct, sub_k, depth = 0.55, 2, 1
    elif n_rows < 50_000:
        pct, sub_k, depth = 0.40, 3, 2
    else:
        pct, sub_k, depth = 0.30, 3, 2
    if mean_skew > 2.0:
        pct, depth = max(0.25, pct - 0.10), min(3, depth + 1)
    gates = {"max_cluster_size_pct": pct if max_pct is None else float(max_pct), "sub_n_clusters": sub_k, "max_depth": depth}
    limits = {"max_cluster_size_pct": (0.15, 0.80), "sub_n_clusters": (2, 6), "max_depth": (1, 4)}
    for key, value in overrides.items():
        low, high = limits[key]
        gates[key] = type(gates[key])(min(high, max(low, value)))
    return gates


def control_gates_of(df: DataFrame, modality: str = "tabular") -> dict:
    numbers = numeric_columns(df)
    stats = df.agg(F.count("*").alias("n"), *[g1_skew(col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(numbers)]).first()
    skews = [abs(stats[f"s{i}"]) for i in range(len(numbers)) if stats[f"s{i}"] is not None and not math.isnan(stats[f"s{i}"])]
    return control_gates(stats["n"], sum(skews) / len(skews) if skews else 0.0, modality)


ALGORITHMS = ("kmeans", "hierarchical", "dbscan", "gmm", "fuzzy_cmeans", "lda", "nmf", "llm_cluster")  # tie order

# words in the stated purpose that favour an algorithm, and the weight of one hit (fixed values)
PURPOSE_WORDS = {
    "hierarchical": (2.0, ("nested", "hierarchy", "sub-segment", "sub segment", "group within", "subgroup", "tier", "level")),
    "kmeans": (1.0, ("simple", "fast", "basic", "broad", "high-level")),
    "dbscan": (2.0, ("outlier", "noise", "density", "irregular", "anomaly")),
    "gmm": (2.0, ("probability", "overlap", "soft", "probabilistic", "multi-modal", "multimodal", "distribution")),
    "fuzzy_cmeans": (2.0, ("fuzzy", "partial membership", "gradual", "soft boundary")),
}


def algorithm_scorecard(
    n_rows: int,
    n_features: int,
    skews: list[float] | None = None,
    purpose: str = "",
    modality: str = "tabular",
    multimodal_features: int | None = None,
    outlier_features: int | None = None,
    preferred: tuple[str, ...] = ("kmeans", "hierarchical"),
    discouraged: tuple[str, ...] = ("gmm", "dbscan", "fuzzy_cmeans"),
) -> dict:
    """Points per algorithm, the winner (first in the fixed order on ties) and a margin-based confidence."""
    mean_skew = sum(abs(s) for s in skews) / len(skews) if skews else 0.0
    top_skew = max((abs(s) for s in skews), default=0.0) if skews else 0.0
    text = purpose.lower()
    is_text = modality == "text"
    votes: list[tuple[bool, str, float]] = [
        (n_rows > 100_000, "kmeans", 3),
        (n_rows < 5_000, "hierarchical", 1),
        (mean_skew > 2.0, "hierarchical", 2),
        (1.0 < mean_skew <= 2.0, "hierarchical", 1),
        (top_skew > 5.0, "dbscan", 1),
        (n_features > 100, "hierarchical", 1),
        ((multimodal_features or 0) >= 3, "hierarchical", 2),
        ((multimodal_features or 0) >= 3, "gmm", 1),
        (not is_text and outlier_features is not None and outlier_features >= max(3, n_features // 10), "dbscan", 2),
        (is_text, "nmf", 1 if n_rows < 200 else 0.5),
        (is_text, "lda", 0.5 if n_rows < 200 else 1),
    ]
    votes += [(any(w in text for w in words), name, weight) for name, (weight, words) in PURPOSE_WORDS.items()]
    votes += [(is_text, name, 3) for name in preferred] + [(is_text, name, -3) for name in discouraged]
    scores = {a: sum(weight for fires, name, weight in votes if fires and name == a) for a in ALGORITHMS}
    ranked = sorted(scores.values(), reverse=True)
    best = max(ALGORITHMS, key=lambda a: scores[a])
    if scores[best] == 0:
        best = "hierarchical"
    confidence = min(0.5 + 0.5 * (ranked[0] - ranked[1]) / max(sum(scores.values()), 1), 1.0)
    return {"algorithm": best, "confidence": round(confidence, 2), "scores": scores}


def outlier_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Range over interquartile range per feature; more than 10 marks an outlier-heavy feature."""
    names = columns or numeric_columns(df)
    quartiles = exact_quantiles(df, {c: [0.25, 0.75] for c in names})
    ends = df.agg(*[x for i, c in enumerate(names) for x in (F.min(col(c)).alias(f"lo{i}"), F.max(col(c)).alias(f"hi{i}"))]).first()
    rows = []
    for i, c in enumerate(names):
        q1, q3 = quartiles[c]
        if q1 is not None:
            ratio = (float(ends[f"hi{i}"]) - float(ends[f"lo{i}"])) / (q3 - q1 + 1e-9)
            rows.append((c, ratio, ratio > 10))
    return df.sparkSession.createDataFrame(rows, "feature string, range_over_iqr double, outlier_heavy boolean")


BINS_PER_WIDTH = 32  # bins of a kernel density in one kernel width


def _kernel_sums(weighted: DataFrame, specs: list[tuple], grid: int, binned: bool) -> tuple[np.ndarray, np.ndarray]:
    """Kernel densities of several columns on their grids, and bounds of their errors; rows are (c, x, w), c a place in ``specs``.

    With ``binned`` a row stands for values no further apart than a bin, at their mean; else it is one value.
    """

    def sums(batches):
        total = np.zeros((2 * len(specs), grid))
        for pdf in batches:
            for c, part in pdf.groupby("c"):
                _, n, lo, hi, width = specs[c]
                u = (np.linspace(lo, hi, grid)[:, None] - part["x"].to_numpy()[None, :]) / width
                w = part["w"].to_numpy() / n
                total[2 * c] += np.exp(-u * u / 2) @ w
                if binned:  # half the spread of a bin's values times the kernel's second derivative anywhere in the bin
                    v = np.maximum(np.abs(u) - 1.0 / BINS_PER_WIDTH, 0.0)
                    total[2 * c + 1] += ((1 + (v + 2.0 / BINS_PER_WIDTH) ** 2) * np.exp(-v * v / 2)) @ w / (8.0 * BINS_PER_WIDTH**2)
        yield from matrix_parts(total)

    found = summed_rows(weighted.mapInPandas(sums, PART_SCHEMA), 2 * len(specs), grid)
    return found[::2], found[1::2]


def multimodal_features(df: DataFrame, columns: list[str] | None = None, grid: int = 200, order: int = 10) -> DataFrame:
    """Peaks of a Gaussian kernel density per feature (with at least 50 values).

    All columns are counted into bins of a 32nd of their kernel width in one pass; the density over the bins has a known error.
    Columns for which two grid points that decide on a peak are closer than that are summed over their values, together.
    """
    names = columns or numeric_columns(df)
    if not names:
        return df.sparkSession.createDataFrame([], "feature string, peaks int, multimodal boolean")
    wide = df.select(*[F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)])
    facts = wide.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(names)) for k, f in (("n", F.count), ("lo", F.min), ("hi", F.max), ("sd", F.stddev_samp))]).first()
    specs = []
    for i, c in enumerate(names):
        if facts[f"n{i}"] >= 50 and facts[f"sd{i}"]:
            n = facts[f"n{i}"]
            specs.append((c, n, facts[f"lo{i}"], facts[f"hi{i}"], facts[f"sd{i}"] * n ** (-1.0 / 5.0)))  # Scott's rule in one dimension
    place = {c: f"x{names.index(c)}" for c, *_ in specs}

    def values(some: list[int]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(j).alias("c"), F.col(place[specs[i][0]]).alias("x"), F.floor((F.col(place[specs[i][0]]) - specs[i][2]) / (specs[i][4] / BINS_PER_WIDTH)).alias("bin")) for j, i in enumerate(some)])
        return wide.select(F.explode(cells).alias("v")).select("v.*").where("x IS NOT NULL")

    peaks: dict[int, int] = {}
    every = list(range(len(specs)))
    if every:
        bins = values(every).groupBy("c", "bin").agg(F.avg("x").alias("x"), F.count("*").cast("double").alias("w"))
        for i, (density, error) in enumerate(zip(*_kernel_sums(bins.select("c", "x", "w"), specs, grid, True))):
            count, sure = _peaks(density, error, order)
            if sure:
                peaks[i] = count
    close = [i for i in every if i not in peaks]
    if close:
        exact = values(close).groupBy("c", "x").agg(F.count("*").cast("double").alias("w"))
        for i, (density, error) in zip(close, zip(*_kernel_sums(exact.select("c", "x", "w"), [specs[i] for i in close], grid, False))):
            peaks[i] = _peaks(density, error, order)[0]
    rows = [(specs[i][0], peaks[i], peaks[i] >= 2) for i in every]
    return df.sparkSession.createDataFrame(rows, "feature string, peaks int, multimodal boolean")


def _peaks(density: np.ndarray, error: np.ndarray, order: int) -> tuple[int, bool]:
    """Inner grid points above all others within ``order``, and whether the error leaves no doubt about any."""
    count, sure = 0, True
    for i in range(1, len(density) - 1):
        near = np.array([j for j in range(max(i - order, 0), min(i + order, len(density) - 1) + 1) if j != i])
        gap, doubt = density[i] - density[near], error[i] + error[near]
        count += bool((gap > 0).all())
        # a neighbour that is higher for sure settles it
        if not (gap < -doubt).any() and not ((gap > doubt) | ((doubt == 0) & (gap == 0))).all():
            sure = False
    return count, sure


SEMANTIC_WORDS = ("semantic", "meaning", "topic", "theme", "intent")  # fixed values


def vectorizer_choice(n_docs: int, avg_tokens: float, purpose: str = "", encoder_available: bool = False) -> dict:
    """TF-IDF or a sentence encoder, from length, corpus size and purpose; no encoder means TF-IDF."""
    transformer = (2.0 if avg_tokens >= 40 else 0.0) + (1.0 if any(w in purpose.lower() for w in SEMANTIC_WORDS) else 0.0)
    tfidf = (0.0 if avg_tokens >= 40 else 2.0) + (1.0 if n_docs > 50_000 else 0.0)
    wanted = "transformer" if transformer > tfidf else "tfidf_svd"
    confidence = round(min(0.5 + 0.5 * abs(transformer - tfidf) / ((transformer + tfidf) or 1.0), 1.0), 2)
    method = wanted if encoder_available else "tfidf_svd"
    return {"method": method, "wanted": wanted, "confidence": confidence, "scores": {"tfidf_svd": tfidf, "transformer": transformer}}


