"""Clustering algorithms over (id, features) tables; each returns (id, cluster_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortry.operators.clustering.density import dbscan
from cohortry.operators.clustering.fuzzy import fuzzy_c_means
from cohortry.operators.clustering.mixtures import gaussian_mixture, kmeans
from cohortry.operators.clustering.topics import lda_topics, nmf_topics
from cohortry.operators.clustering.ward import ward

GEOMETRIC = ("kmeans", "hierarchical", "gmm", "dbscan", "fuzzy_cmeans")
TOPIC = ("lda", "nmf")


def fit_labels(algorithm: str, vectors: DataFrame, k: int | None, seed: int = 42, restarts: int | None = None, metric: str = "euclidean", terms=None) -> DataFrame:
    """Dispatch by algorithm name; topic models read ``terms`` (a corpus of TF-IDF rows) instead of vectors."""
    if algorithm == "kmeans":
        return kmeans(vectors, k, seed=seed, restarts=restarts or 15, max_iter=500, metric=metric)
    if algorithm == "hierarchical":
        return ward(vectors, k, seed=seed)
    if algorithm == "gmm":
        return gaussian_mixture(vectors, k, seed=seed, restarts=restarts or 5)
    if algorithm == "dbscan":
        return dbscan(vectors)
    if algorithm == "fuzzy_cmeans":
        return fuzzy_c_means(vectors, k, seed=seed)
    if algorithm in TOPIC:
        if terms is None:
            raise ValueError(f"{algorithm} needs the TF-IDF rows of the corpus")
        return (lda_topics if algorithm == "lda" else nmf_topics)(terms, k, seed=seed)
    raise ValueError(f"unknown algorithm {algorithm!r}")
