"""Feature scores, the multicollinearity gate and the final subset."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.algebra import (
    beta_tail,
    dependent_columns,
    eigen_descending,
    standardised_covariance,
    triangular_factor,
    vif_from_correlation,
)
from cohortry.functions.columns import col, min_max_scaled, numeric_columns
from cohortry.functions.moments import column_moments
from cohortry.functions.partials import blocks_of, summed_blocks
from cohortry.operators.cleaning import prepare_matrix, standardise, standardise_with

VIF_THRESHOLD = 10.0
CORRELATION_THRESHOLD = 0.85
MAX_COMPONENTS = 50
MIN_SURVIVORS = 10
DEFAULT_REQUEST = 55
NETWORK_ROWS = 1_024  # rows of a block, whose layers stay in a core's cache


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------


def pca_importance(covariance: np.ndarray, names: list[str], components: int = MAX_COMPONENTS) -> dict[str, float]:
    """Squared loadings weighted by explained variance; the sign of a component does not matter."""
    values, vectors = eigen_descending(covariance)
    ratio = values / (values.sum() or 1.0)
    k = min(components, len(names))
    scores = (vectors[:, :k] ** 2 * ratio[:k]).sum(axis=1)
    return dict(zip(names, scores.tolist()))


def explained_variance(df: DataFrame, columns: list[str], k: int = 2) -> list[float]:
    """Shares of the first components, over the rows without a missing value."""
    df = complete_rows(df, columns)
    values, _ = eigen_descending(standardised_covariance(df, columns))
    return [round(float(v), 4) for v in (values / (values.sum() or 1.0))[:k]]


def bottleneck_width(n_features: int, cap: int = 32) -> int:
    return min(max(8, n_features // 5), cap)


def reconstruction_error(covariance: np.ndarray, names: list[str], width: int | None = None) -> dict[str, float]:
    """Per-feature error of the best linear bottleneck of the given width, in closed form.

    Stands in for the squared error of a trained autoencoder: what the first
    ``width`` components leave unexplained of each standardised feature.
    """
    values, vectors = eigen_descending(covariance)
    b = bottleneck_width(len(names)) if width is None else width
    left = (vectors[:, b:] ** 2 * values[b:]).sum(axis=1) if b < len(names) else np.zeros(len(names))
    return dict(zip(names, left.tolist()))


def network_reconstruction_error(
    df: DataFrame, columns: list[str], width: int | None = None, epochs: int = 40, hidden: int = 64, rate: float = 0.01, seed: int = 42
) -> dict[str, float]:
    """The same score from a ReLU network p-64-b-64-p, trained data-parallel.

    Each epoch is one pass over packed blocks: tasks return the summed gradient of
    their rows (the weights are a few thousand numbers), the driver takes an Adam step.
    """
    p, b = len(columns), width or bottleneck_width(len(columns))
    sizes = [p, hidden, b, hidden, p]
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, math.sqrt(2.0 / m), (m, n)) for m, n in zip(sizes, sizes[1:])] + [np.zeros(n) for n in sizes[1:]]
    data = standardise(df.select(*[col(c).cast("double").alias(c) for c in columns]), columns)

    def pack(batches):
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            for at in range(0, len(x), NETWORK_ROWS):
                some = np.ascontiguousarray(x[at : at + NETWORK_ROWS])
                yield pd.DataFrame({"n": [len(some)], "x": [some.tobytes()]})

    packed = data.mapInPandas(pack, "n long, x binary").persist(StorageLevel.MEMORY_AND_DISK)
    n_rows, n_blocks = packed.agg(F.sum("n"), F.count("*")).first()
    cores, held = df.sparkSession.sparkContext.defaultParallelism, [packed]
    if packed.rdd.getNumPartitions() < cores and n_blocks > packed.rdd.getNumPartitions():  # small inputs arrive in few partitions
        held.append(packed.repartition(min(n_blocks, cores)).persist(StorageLevel.MEMORY_AND_DISK))
    blocks = blocks_of(held[-1], "x")
    layers = len(sizes) - 1
    edges = np.cumsum([p, *(w.size for w in weights)])

    def run(ws, gradients: bool):
        shipped = df.sparkSession.sparkContext.broadcast(ws)

        def add(total, block):
            ws, flat = shipped.value, total[0]
            x = np.frombuffer(block["x"], dtype=float).reshape(-1, p)
            acts = [x]
            for i in range(layers):
                z = acts[-1] @ ws[i]
                z += ws[layers + i]
                acts.append(np.maximum(z, 0.0, out=z) if i < layers - 1 else z)
            delta = acts[-1] - x
            flat[:p] += np.square(delta).sum(axis=0)
            if gradients:
                delta *= 2.0
                for i in reversed(range(layers)):
                    flat[edges[i] : edges[i + 1]] += (acts[i].T @ delta).ravel()
                    flat[edges[layers + i] : edges[layers + i + 1]] += delta.sum(axis=0)
                    if i:
                        delta = delta @ ws[i].T
                        delta *= acts[i] > 0

        summed = summed_blocks(blocks, add, 1, int(edges[-1]))[0]
        shipped.destroy()
        return summed[:p], summed[p:]

    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, epochs + 1):
        _, flat = run(weights, True)
        at = 0
        for i, w in enumerate(weights):
            g = flat[at : at + w.size].reshape(w.shape) / (n_rows * p)
            at += w.size
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            weights[i] = w - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    error, _ = run(weights, False)
    for one in held:
        one.unpersist()
    return dict(zip(columns, (error / n_rows).tolist()))


def combined_rank(scores: DataFrame) -> DataFrame:
    """Half min-max PCA score plus half min-max reconstruction error, ranked descending.

    ``scores`` has one row per feature: feature, pca_score, recon_error.
    """
    combined = 0.5 * min_max_scaled(F.col("pca_score"), 0.0) + 0.5 * min_max_scaled(F.col("recon_error"), 0.0)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("combined_score"), "feature"))
    return scores.withColumn("combined_score", combined).withColumn("rank", rank)


def prefilter(ranked: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best-ranked features."""
    return ranked.where(F.col("rank") <= keep)


# ---------------------------------------------------------------------------
# multicollinearity
# ---------------------------------------------------------------------------


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles, less the rows in which one is null or NaN."""
    return df.select(*[col(c).cast("double").alias(c) for c in columns]).dropna()


def columns_without_gaps(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns without a null or NaN value, in order."""
    x = [col(c).cast("double") for c in columns]
    if not x:
        return []
    gaps = df.agg(*[F.count(F.when(v.isNull() | F.isnan(v), 1)).alias(f"g{i}") for i, v in enumerate(x)]).first()
    return [c for i, c in enumerate(columns) if not gaps[i]]


def compute_vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation factor per column, largest first, from one pass over the data; columns with missing values drop out."""
    columns = columns_without_gaps(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, vif double")
    found = vif_from_correlation(standardised_covariance(df, columns), columns)
    rows = sorted(((n, float(v)) for n, v in found.items()), key=lambda x: (-x[1] if x[1] == x[1] else 0.0, x[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, vif double")


def remove_high_vif(
    df: DataFrame,
    columns: list[str],
    threshold: float = VIF_THRESHOLD,
    min_features: int = 5,
    max_rounds: int = 200,
    rank_pass: bool = True,
    covariance: np.ndarray | None = None,
    moments: dict | None = None,
) -> tuple[list[str], list[str], dict[str, float]]:
    """(kept, removed in order, VIF of the kept).

    Two passes over the rows in total, however many rounds run: one for the
    triangular factor, one for the correlations (none when ``covariance`` of the
    standardised columns is at hand).
    """
    names, removed = list(columns), []
    if rank_pass and len(names) >= 2:
        body = df.select(*[col(c).cast("double").alias(c) for c in names])
        scaled = standardise(body, names) if moments is None else standardise_with(body, {c: moments[c] for c in names})
        extra = dependent_columns(triangular_factor(scaled, names), names)
        if extra and len(names) - len(extra) >= min_features:
            removed += extra
            names = [n for n in names if n not in extra]
    if covariance is not None:
        at = [list(columns).index(n) for n in names]
        matrix = covariance[np.ix_(at, at)]
    else:
        matrix = standardised_covariance(df, names) if names else np.zeros((0, 0))
    alive = list(range(len(names)))
    vif: dict[str, float] = {}
    for _ in range(max_rounds + 1):
        current = [names[i] for i in alive]
        vif = vif_from_correlation(matrix[np.ix_(alive, alive)], current)
        if len(alive) <= min_features or len(alive) < 2:
            break
        worst = max(alive, key=lambda i: vif[names[i]])
        if vif[names[worst]] <= threshold or len(removed) - (len(columns) - len(names)) >= max_rounds:
            break
        removed.append(names[worst])
        alive.remove(worst)
    return [names[i] for i in alive], removed, vif


def high_correlations(df: DataFrame, columns: list[str], threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Pairs with |r| at or above the threshold, 4 decimals, largest first; over the rows without a missing value."""
    df = complete_rows(df, columns)
    return df.sparkSession.createDataFrame(
        correlated_pairs(standardised_covariance(df, columns), columns, threshold), "feature_a string, feature_b string, correlation double"
    )


def correlated_pairs(covariance: np.ndarray, columns: list[str], threshold: float = CORRELATION_THRESHOLD) -> list[tuple[str, str, float]]:
    pairs = [
        (a, columns[j], round(abs(float(covariance[i, j])), 4))
        for i, a in enumerate(columns)
        for j in range(i + 1, len(columns))
        if covariance[i, i] > 0 and covariance[j, j] > 0 and abs(covariance[i, j]) >= threshold
    ]
    return sorted(pairs, key=lambda x: -x[2])


def anova(df: DataFrame, columns: list[str], label: str, alpha: float = 0.05) -> DataFrame:
    """One-way F statistic and p-value of each feature against a label; groups need two or more values."""
    per = []
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        per += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    groups = df.where(col(label).isNotNull()).groupBy(col(label).alias("_label")).agg(*per)
    long = groups.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")) for i, c in enumerate(columns)])
        ).alias("s")
    ).select("s.*")
    usable = long.where("n > 1")
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    totals = usable.groupBy("feature").agg(F.count("*").alias("k"), F.sum("n").alias("n"), grand.alias("g"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = usable.withColumnsRenamed({"n": "gn"}).select("feature", "gn", "m").join(totals, "feature")
    f = (
        between.groupBy("feature", "k", "n", "within")
        .agg(F.sum(F.col("gn") * F.pow(F.col("m") - F.col("g"), 2)).alias("between"))
        .where("k > 1")
        .select("feature", "k", "n", ((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_stat"))
    )
    found = {r["feature"]: r for r in f.collect()}  # one row per feature
    rows = []
    for c in columns:
        hit = found.get(c)
        if hit is None or hit["f_stat"] is None:
            rows.append((c, None, None, False))
        else:
            p = beta_tail(hit["f_stat"], hit["k"] - 1, hit["n"] - hit["k"])
            rows.append((c, float(hit["f_stat"]), p, p < alpha))
    rows.sort(key=lambda x: (x[2] is None, x[2]))
    return df.sparkSession.createDataFrame(rows, "feature string, f_stat double, p_value double, significant boolean")


# ---------------------------------------------------------------------------
# the selector
# ---------------------------------------------------------------------------


@dataclass
class Selection:
    selected: list[str]
    ranking: DataFrame
    vif: dict[str, float]
    removed_by_vif: list[str]
    prefiltered: list[str]
    blocked: bool = False
    reason: str = ""

    @property
    def max_vif(self) -> float:
        finite = [v for v in self.vif.values() if v == v]
        return max(finite) if finite else 1.0


def ranking_table(ranked: DataFrame, vif: DataFrame) -> DataFrame:
    """Survivors of the gate with their original rank, scores and rounded VIF."""
    return (
        ranked.join(F.broadcast(vif), "feature")  # one row per feature on both sides
        .select("rank", "feature", F.round("pca_score", 6).alias("pca_score"), F.round("recon_error", 6).alias("recon_error"),
                F.round("combined_score", 6).alias("combined_score"), F.round("vif", 2).alias("vif"))
        .orderBy("rank")
    )


def default_request(ranking: DataFrame, pairs: DataFrame, limit: int = DEFAULT_REQUEST) -> DataFrame:
    """Ranked features without the lower-ranked member of each highly correlated pair, first 55."""
    ranks = ranking.select("feature", "rank")
    a, b = ranks.toDF("feature_a", "rank_a"), ranks.toDF("feature_b", "rank_b")
    losers = pairs.join(a, "feature_a").join(b, "feature_b").select(
        F.when(F.col("rank_a") > F.col("rank_b"), F.col("feature_a")).otherwise(F.col("feature_b")).alias("feature")
    )
    return ranking.join(losers, "feature", "left_anti").orderBy("rank").limit(limit)


def select_features(
    df: DataFrame,
    entity: str,
    columns: list[str] | None = None,
    vif_threshold: float = VIF_THRESHOLD,
    requested=None,
    modality: str = "tabular",
    nonlinear: bool = False,
    keep: int | None = None,
) -> Selection:
    """Scores, rank and VIF gates, ranking, and the requested (or default) subset.

    ``requested`` is a list of names or a callable from the ranking rows to one.
    ``keep`` lets only the best-ranked features into the gates.
    Text embeddings skip all of it and keep every dimension.
    """
    names = columns or numeric_columns(df, exclude=[entity])
    spark = df.sparkSession
    if modality == "text":
        kept = [c for c in names if c.startswith("emb_")] or names
        empty = spark.createDataFrame([], "rank int, feature string, pca_score double, recon_error double, combined_score double, vif double")
        return Selection(kept, empty, {}, [], [])
    body = df.select(*[col(c) for c in names]).persist(StorageLevel.MEMORY_AND_DISK)
    moments = column_moments(body, names)
    matrix, alive = prepare_matrix(body, names, moments)
    if any(moments[c].nulls or moments[c].infinities for c in alive):
        moments = column_moments(matrix, alive)
    covariance = standardised_covariance(matrix, alive, {c for c in alive if moments[c].constant})
    pca = pca_importance(covariance, alive)
    recon = network_reconstruction_error(matrix, alive) if nonlinear else reconstruction_error(covariance, alive)
    scores = spark.createDataFrame([(c, pca[c], recon[c]) for c in alive], "feature string, pca_score double, recon_error double")
    ranked = combined_rank(scores)
    order = [r["feature"] for r in ranked.orderBy("rank").collect()]
    wide = alive if keep is None else order[:keep]
    at = [alive.index(c) for c in wide]
    kept, removed, vif = remove_high_vif(
        matrix, wide, vif_threshold, min_features=MIN_SURVIVORS, covariance=covariance[np.ix_(at, at)], moments=moments
    )
    body.unpersist()
    vif_table = spark.createDataFrame([(n, float(v)) for n, v in vif.items()], "feature string, vif double")
    ranking = ranking_table(ranked, vif_table)
    out = [c for c in alive if c not in wide]
    if len(kept) < MIN_SURVIVORS:
        return Selection([], ranking, vif, removed, out, True, f"Only {len(kept)} features after the VIF gate (min {MIN_SURVIVORS}).")
    rows = ranking.collect()
    if callable(requested):
        requested = requested(rows)
    if requested is not None:
        chosen = [c for c in requested if c in kept]
    else:
        at = [alive.index(c) for c in kept]
        pairs = correlated_pairs(covariance[np.ix_(at, at)], kept)
        table = spark.createDataFrame(pairs, "feature_a string, feature_b string, correlation double")
        chosen = [r["feature"] for r in default_request(ranking, table).collect()]
    return Selection(chosen or kept, ranking, vif, removed, out)


