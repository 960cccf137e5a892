"""Can a classifier learn the segments back?  Stratified folds, models, scores, gate."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.blocks import block_pairs
from cohortry.functions.columns import col
from cohortry.operators import boosting, forest, kernel, logistic
from cohortry.operators.boosting import Boosting
from cohortry.operators.cleaning import log_columns, log_transform
from cohortry.session import MAX_CLUSTERS, cut_lineage, take_bounded

F1_TARGET = {"tabular": 0.70, "text": 0.60}
FOLD_SHIFT = 52  # the top 12 bits of the hash: 4096 buckets per class


def attach_personas(labelled: DataFrame, personas: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Rows whose cluster has a persona, with its name; the rest drop out."""
    names = personas.select(F.col("cluster_id").alias("_c"), F.col("name").alias("persona"))
    return labelled.join(F.broadcast(names), col(label) == F.col("_c")).drop("_c")  # one row per cluster


def unmapped_rows(labelled: DataFrame, personas: DataFrame, label: str = "cluster_id") -> DataFrame:
    names = personas.select(F.col("cluster_id").alias("_c"))
    return labelled.join(F.broadcast(names), col(label) == F.col("_c"), "left_anti").agg(F.count("*").alias("n_unmapped"))


def class_distribution(labelled: DataFrame, label: str) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return labelled.groupBy(col(label).alias("label")).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)


def n_folds(smallest_class: int) -> int:
    return min(5, max(2, smallest_class))


def stratified_folds(df: DataFrame, key: str, label: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold``: the seeded-hash rank inside the class, modulo k.

    The rank is split into a count of earlier hash buckets plus a rank inside
    the bucket, so that a class with most of the rows is not sorted in one task.
    """
    folds = k
    if folds is None:
        smallest = df.groupBy(col(label)).count().agg(F.min("count")).first()[0]
        folds = n_folds(smallest or 2)
    mark = F.xxhash64(col(key), F.lit(seed))
    placed = df.withColumns({"_h": mark, "_b": F.shiftright(mark, FOLD_SHIFT)})
    counts = placed.groupBy(col(label).alias("_y"), "_b").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select("_y", F.col("_b").alias("_bb"), "_o")
    local = F.row_number().over(Window.partitionBy(col(label), F.col("_b")).orderBy("_h", col(key)))
    ranked = placed.withColumn("_r", local)
    joined = ranked.join(offsets, ranked[label].eqNullSafe(offsets["_y"]) & (F.col("_b") == F.col("_bb")))
    return joined.withColumn("fold", F.pmod(F.col("_o") + F.col("_r") - 1, F.lit(folds)).cast("int")).drop("_h", "_b", "_bb", "_y", "_o", "_r")


# ---------------------------------------------------------------------------
# models
# ---------------------------------------------------------------------------

# accepted names -> family
MODELS = {
    "random_forest": "forest", "xgboost": "boosted", "lightgbm": "boosted", "gradient_boosting": "boosted",
    "logistic_regression": "logistic", "logistic": "logistic", "knn": "neighbours", "svm": "kernel", "naive_bayes": "bayes",
}
# the boosters' own defaults; the second grows by levels here, to 32 leaves
BOOSTERS = {
    "xgboost": Boosting(),
    "lightgbm": Boosting(depth=5, rate=0.1, ridge=0.0, least_hessian=1e-3, least_rows=20),
    "gradient_boosting": Boosting(trees=100, depth=3, rate=0.1, ridge=0.0, least_hessian=0.0),
}
NEIGHBOURS = 5
FOURIER_FEATURES = 128
STRIPE = 256  # rows of a block compared at a time inside a task, with twice as many of the other


def build_estimator(name: str, seed: int = 42, trees: int = 200, rows: int | None = None):
    """A Spark estimator for the named model; unknown names mean the forest.

    ``rows`` scales the logistic model's penalty, which is one over all rows.
    """
    family = MODELS.get(str(name).lower(), "forest")
    shared = {"featuresCol": "features", "labelCol": "y", "predictionCol": "pred"}
    if family == "boosted":
        raise ValueError("boosted trees are fitted by operators.boosting")
    if family == "logistic":
        return LogisticRegression(maxIter=200, standardization=True, regParam=1.0 / rows if rows else 0.0, **shared)
    if family == "bayes":
        return NaiveBayes(modelType="gaussian", **shared)
    if family == "kernel":
        return OneVsRest(classifier=LinearSVC(featuresCol="features", maxIter=20, tol=1e-4, regParam=1e-3), **shared)
    return RandomForestClassifier(numTrees=trees, maxDepth=10, seed=seed, **shared)


def boosting_of(model: str, trees: int) -> Boosting:
    """A booster's defaults; ``trees`` counts for those that have 200."""
    how = BOOSTERS[model]
    return replace(how, trees=trees) if how.trees == 200 else how


def fourier_map(prepared: DataFrame, n_features: int = FOURIER_FEATURES, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and phases of random cosine features of an RBF kernel with gamma = 1 / (d x variance)."""
    sample = prepared.select(F.size(vector_to_array("features")).alias("d")).first()["d"]
    flat = prepared.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0] or 1.0
    gamma = 1.0 / (sample * flat)
    rng = np.random.default_rng(seed)
    return rng.normal(0, np.sqrt(2 * gamma), (sample, n_features)), rng.uniform(0, 2 * np.pi, n_features)


def fourier_features(prepared: DataFrame, n_features: int = FOURIER_FEATURES, seed: int = 42) -> DataFrame:
    """The rows lifted by :func:`fourier_map`."""
    w, b = fourier_map(prepared, n_features, seed)

    @F.pandas_udf("array<double>")
    def lift(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(np.vstack(v) @ w + b)))

    return prepared.withColumn("features", array_to_vector(lift(vector_to_array("features"))))


def label_codes(df: DataFrame, label: str) -> tuple[DataFrame, list]:
    """Add ``y`` = position of the label in sorted order (bounded by the class count)."""
    classes = sorted(r[0] for r in take_bounded(df.select(col(label)).distinct(), MAX_CLUSTERS, "classes"))
    table = df.sparkSession.createDataFrame([(c, float(i)) for i, c in enumerate(classes)], f"_l {dict(df.dtypes)[label]}, y double")
    return df.join(F.broadcast(table), col(label) == F.col("_l")).drop("_l"), classes


def _keep_nearest(x: np.ndarray, known: np.ndarray, classes: np.ndarray, d: np.ndarray, y: np.ndarray) -> None:
    """Put known points (in the order of classes) in their places among the nearest ``d, y`` of each row of x, by distance and class."""
    k = d.shape[1]
    dist = x @ known.T
    dist *= -2.0
    dist += (x * x).sum(axis=1)[:, None]
    dist += (known * known).sum(axis=1)
    closer = dist <= d[:, -1:]
    rows = np.flatnonzero(closer.any(axis=1))
    if not len(rows):
        return
    dist, closer = np.maximum(dist[rows], 0.0), closer[rows]
    many = np.flatnonzero(closer.sum(axis=1) > k)
    if len(many):  # no more than k can stay: the nearest, in the order of classes
        some = dist[many]
        edge = np.partition(some, k - 1, axis=1)[:, k - 1 : k]
        inside, even = some < edge, some == edge
        closer[many] = inside | (even & (even.cumsum(axis=1) <= k - inside.sum(axis=1, keepdims=True)))
    at, to = np.nonzero(closer)
    who = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
    far, marks = np.concatenate([dist[at, to], d[rows].ravel()]), np.concatenate([classes[to], y[rows].ravel()])
    order = np.lexsort((marks, far, who))
    first = np.searchsorted(who[order], np.arange(len(rows)))[:, None] + np.arange(k)
    d[rows], y[rows] = far[order][first], marks[order][first]


def nearest_neighbour_votes(train: DataFrame, test: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Exact k-nearest-neighbour majority vote.

    Blocks of test and training points are compared in tasks, which hold the k
    nearest of each test point so far (of equally far ones the smaller class);
    the k nearest over all tasks are taken afterwards.
    """
    kind = dict(test.dtypes)["id"]

    def closest(points: dict, others: dict, best) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(np.array(others["y"], dtype=float), kind="stable")
        classes, known = np.array(others["y"], dtype=float)[order], others["x"][order]
        x = points["x"]
        best = best if best is not None else (np.full((len(x), k), np.inf), np.full((len(x), k), np.inf))
        for i in range(0, len(known), 2 * STRIPE):  # pieces that stay in a core's cache
            for j in range(0, len(x), STRIPE):
                _keep_nearest(x[j : j + STRIPE], known[i : i + 2 * STRIPE], classes[i : i + 2 * STRIPE], *(v[j : j + STRIPE] for v in best))
        return best

    def finish(points: dict, best) -> pd.DataFrame:
        d, y = (v.reshape(-1) for v in best)
        found = np.isfinite(d)
        return pd.DataFrame({"id": np.repeat(np.array(points["id"], dtype=object), k)[found], "d": d[found], "y": y[found]})

    queries = test.select("id", vector_to_array("features").alias("features"))
    known = train.select("id", vector_to_array("features").alias("features"), "y")
    near = block_pairs(queries, known, closest, finish, f"id {kind}, d double, y double")
    first = near.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "y"))), 1, k).alias("n"))
    votes = first.select("id", F.explode("n").alias("v")).groupBy("id", F.col("v.y").alias("y")).agg(F.count("*").alias("c"))
    return votes.groupBy("id").agg(F.max_by("y", F.struct("c", -F.col("y"))).alias("pred"))


def prepare_classes(df: DataFrame, key: str, label: str, columns: list[str]) -> tuple[DataFrame, list]:
    """(id, y, features) with skewed columns logged."""
    logged = log_transform(df, log_columns(df, columns))
    coded, classes = label_codes(logged, label)
    vector = array_to_vector(F.array(*[F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns]))
    return coded.select(col(key).alias("id"), "y", vector.alias("features")), classes


def cross_validate(df: DataFrame, key: str, label: str, columns: list[str], model: str = "random_forest", folds: int | None = None, seed: int = 42, trees: int = 200) -> tuple[DataFrame, list]:
    """Out-of-fold predictions, one per row: ``id, y, pred`` with codes into the returned class list."""
    prepared, classes = prepare_classes(df, key, label, columns)
    family = MODELS.get(model, "forest")
    placed = stratified_folds(prepared, "id", "y", folds, seed).persist()
    top = placed.agg(F.max("fold").alias("k"), F.count("*").alias("n")).first()
    k = top["k"] + 1
    if family == "boosted":
        result = cut_lineage(boosting.out_of_fold(placed, len(classes), boosting_of(model, trees)))
        placed.unpersist()
        return result, classes
    if family == "forest":
        result = forest.out_of_fold(placed, len(classes), k, trees, seed=seed)
        placed.unpersist()
        return result, classes
    if family == "kernel":
        result = kernel.out_of_fold(placed, len(classes), k, *fourier_map(placed, seed=seed))
        placed.unpersist()
        return result, classes
    if family == "logistic" and len(classes) * (len(columns) + 1) <= logistic.MOST_WEIGHTS:
        result = cut_lineage(logistic.out_of_fold(placed, len(classes), k, 1.0 / top["n"]))
        placed.unpersist()
        return result, classes
    out = None
    for i in range(k):
        train, test = placed.where(F.col("fold") != i), placed.where(F.col("fold") == i)
        if family == "neighbours":
            done = test.select("id", "y").join(nearest_neighbour_votes(train, test), "id")
        else:
            done = build_estimator(model, seed, trees, top["n"]).fit(train).transform(test).select("id", "y", "pred")
        out = done if out is None else out.unionByName(done)
    result = cut_lineage(out)
    placed.unpersist()
    return result, classes


def feature_importances(df: DataFrame, key: str, label: str, columns: list[str], model: str = "random_forest", seed: int = 42, trees: int = 200) -> DataFrame:
    """Tree importances, or mean absolute coefficients, or zeros; largest first."""
    prepared, classes = prepare_classes(df, key, label, columns)
    values = np.zeros(len(columns))
    if MODELS.get(model, "forest") == "boosted":
        values = boosting.importances(prepared.persist(), len(classes), boosting_of(model, trees))
        prepared.unpersist()
    elif MODELS.get(model, "forest") == "forest":
        values = forest.importances(prepared, len(classes), trees, seed=seed)
    elif MODELS.get(model, "forest") == "logistic":
        fitted = build_estimator(model, seed, trees, prepared.count()).fit(prepared)
        values = np.abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
    rows = sorted(((c, round(float(v), 6)) for c, v in zip(columns, values)), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


# ---------------------------------------------------------------------------
# scores
# ---------------------------------------------------------------------------


def confusion(predictions: DataFrame, truth: str = "y", predicted: str = "pred") -> DataFrame:
    return predictions.groupBy(col(truth).alias("y"), col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(cells: DataFrame) -> DataFrame:
    """Per class: support, predicted, hits, F1 (0 when undefined); classes seen on either side count."""
    rows = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    cols = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "label", "full").na.fill(0, ["support", "hits", "predicted"])
    size = F.col("support") + F.col("predicted")
    return both.withColumn("f1", F.when(size > 0, 2.0 * F.col("hits") / size).otherwise(0.0))


def overall_scores(cells: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, Cohen's kappa."""
    per = class_scores(cells)
    n = F.sum("support")
    expected = F.sum(F.col("support").cast("double") * F.col("predicted")) / (n * n)
    accuracy = F.sum("hits") / n
    return per.agg(
        accuracy.alias("accuracy"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"),
        F.when(expected < 1, (accuracy - expected) / (1 - expected)).otherwise(F.lit(float("nan"))).alias("kappa"),
    )


def f1_gate(scores: DataFrame, per_class: DataFrame, modality: str = "tabular", retry: str = "recluster") -> DataFrame:
    """Proceed at or above the target, otherwise go back; the three hardest classes are named either way."""
    target = F1_TARGET[modality]
    hardest = per_class.orderBy("f1", "label").limit(3).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("f1", "label"))), lambda x: x["label"].cast("string")).alias("hardest")
    )
    action = F.when(F.col("f1_macro") >= target, "proceed").otherwise(retry)
    return scores.select("f1_macro", action.alias("action"), F.lit(1).alias("_k")).join(hardest.withColumn("_k", F.lit(1)), "_k").drop("_k")
