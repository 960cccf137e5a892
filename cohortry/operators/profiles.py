"""What marks each cluster: means against the whole, distinctive terms, evidence views."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.columns import col, seeded_order
from cohortry.functions.vectors import cluster_stats
from cohortry.functions.algebra import standardised_covariance
from cohortry.sources.tables import sample_rows

TOP_FEATURES = 10
TOP_TERMS = 12
REPRESENTATIVES = 3


def cluster_profiles(df: DataFrame, features: list[str], label: str = "cluster_id") -> DataFrame:
    """``cluster_id, n_entities, pct_total, feature, position, mean, relative`` from one grouping.

    The global means follow from the cluster sums, so the rows are read once.
    """
    sums = [x for i, c in enumerate(features) for x in (F.sum(col(c).cast("double")).alias(f"s{i}"), F.count(col(c)).alias(f"n{i}"))]
    grouped = df.groupBy(col(label).alias("cluster_id")).agg(F.count("*").alias("n_entities"), *sums)
    long = grouped.select(
        "cluster_id",
        "n_entities",
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n")) for i, c in enumerate(features)])
        ).alias("f"),
    ).select("cluster_id", "n_entities", "f.*")
    whole = Window.partitionBy("feature")
    overall = F.sum("s").over(whole) / F.sum("n").over(whole)
    mean = F.col("s") / F.col("n")
    relative = F.coalesce(F.when(F.col("_g") != 0, F.col("mean") / F.col("_g")), F.lit(1.0))
    return (
        long.withColumns({"mean": mean, "_g": overall, "_total": F.sum("n_entities").over(whole)})
        .withColumn("relative", relative)
        .select(
            "cluster_id", "n_entities", F.round(F.col("n_entities") / F.col("_total") * 100, 1).alias("pct_total"),
            "feature", "position", "mean", "relative",
        )
    )


def published(profiles: DataFrame) -> DataFrame:
    """Means to 4 and ratios to 3 decimals, as the saved profiles show them."""
    return profiles.withColumns({"mean": F.round("mean", 4), "relative": F.round("relative", 3)})


def top_features(profiles: DataFrame, n: int = TOP_FEATURES, strict: bool = False) -> DataFrame:
    """The n highest and n lowest ratios per cluster; ``strict`` keeps only ratios above / below 1."""
    high = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("relative"), "position"))
    low = F.row_number().over(Window.partitionBy("cluster_id").orderBy("relative", "position"))
    ranked = profiles.withColumns({"_hi": high, "_lo": low})
    keep_hi = (F.col("_hi") <= n) & (F.lit(not strict) | (F.col("relative") > 1))
    keep_lo = (F.col("_lo") <= n) & (F.lit(not strict) | (F.col("relative") < 1))
    sides = F.array_compact(
        F.array(
            F.when(keep_hi, F.struct(F.lit("above").alias("side"), F.col("_hi").alias("rank"))),
            F.when(keep_lo, F.struct(F.lit("below").alias("side"), F.col("_lo").alias("rank"))),
        )
    )
    return ranked.withColumn("_s", F.explode(sides)).select(
        "cluster_id", "n_entities", "pct_total", "_s.side", "_s.rank", "feature", "position", "mean", "relative", F.round("relative", 2).alias("ratio")
    )


def profile_documents(profiles: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """One row per cluster with maps of means, ratios and top features."""
    tops = top_features(profiles, n)

    def pack(side: str) -> Column:
        entry = F.struct("rank", F.col("feature").alias("f"), F.col("ratio").alias("v"))
        ordered = F.sort_array(F.collect_list(F.when(F.col("side") == side, entry)))
        return F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["f"], x["v"])))

    sides = tops.groupBy("cluster_id").agg(pack("above").alias("top_above_average"), pack("below").alias("top_below_average"))
    shown = published(profiles)

    def whole(value: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct("position", "feature", value)))
        return F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["feature"], x[value])))

    body = shown.groupBy("cluster_id", "n_entities", "pct_total").agg(whole("mean").alias("feature_means"), whole("relative").alias("feature_relative"))
    return body.join(sides, "cluster_id")


def signal(relative: Column) -> Column:
    return (
        F.when(relative >= 2.0, "STRONG_ABOVE_2x")
        .when(relative >= 1.4, "ABOVE_1.4x")
        .when(relative >= 1.0, "MODERATE_ABOVE")
        .when(relative >= 0.6, "NEUTRAL")
        .otherwise("BELOW")
    )


def metrics_table(profiles: DataFrame, personas: DataFrame) -> DataFrame:
    """Long table of the top features per cluster with a signal bucket; unnamed clusters get a default name."""
    tops = top_features(profiles).select("cluster_id", "n_entities", "pct_total", "feature", "mean", "ratio").distinct()
    named = tops.join(personas.select("cluster_id", F.col("name").alias("_name")), "cluster_id", "left")
    return named.select(
        "cluster_id",
        F.coalesce("_name", F.concat(F.lit("Cluster "), F.col("cluster_id").cast("string"))).alias("persona_name"),
        "n_entities",
        F.round(F.col("pct_total") / 100, 4).alias("pct_of_total"),
        "feature",
        F.round(F.round("mean", 4), 6).alias("mean_value"),
        F.round("ratio", 4).alias("relative_to_avg"),
        signal(F.col("ratio")).alias("signal"),
    )


def size_check(profiles: DataFrame, cap: float = 0.40) -> DataFrame:
    share = F.col("pct_total") / 100
    return (
        profiles.select("cluster_id", "n_entities", "pct_total")
        .distinct()
        .select("cluster_id", "n_entities", share.alias("share"), F.when(share <= cap, "OK").otherwise("EXCEEDS").alias("status"))
    )


# ---------------------------------------------------------------------------
# merging by the user, grouping, evidence
# ---------------------------------------------------------------------------


def merge_clusters(profiles: DataFrame, ids: list[int]) -> DataFrame:
    """Replace some clusters by one: size-weighted means, summed shares, ratios to the size-weighted overall mean."""
    chosen = [int(i) for i in dict.fromkeys(ids)]
    known = {r["cluster_id"] for r in profiles.select("cluster_id").distinct().collect()}
    missing = [i for i in chosen if i not in known]
    if len(chosen) < 2 or missing:
        raise ValueError(f"need at least two known clusters, unknown: {missing}")
    free = min(i for i in range(len(known) + 1) if i not in known)
    n = F.col("n_entities")
    overall = profiles.groupBy("feature").agg((F.sum(F.col("mean") * n) / F.sum(n)).alias("_g"))
    source = profiles.where(F.col("cluster_id").isin(chosen))
    shares = source.select("cluster_id", "n_entities", "pct_total").distinct().agg(
        F.sum("n_entities").alias("n_entities"), F.round(F.sum("pct_total"), 2).alias("pct_total")
    )
    size = shares.first()
    merged = source.groupBy("feature", "position").agg(F.round(F.sum(F.col("mean") * n) / F.sum(n), 6).alias("mean")).join(overall, "feature")
    ratio = F.when(F.abs("_g") >= 1e-12, F.round(F.col("mean") / F.col("_g"), 4))
    fresh = merged.select(
        F.lit(free).cast(dict(profiles.dtypes)["cluster_id"]).alias("cluster_id"),
        F.lit(size["n_entities"]).alias("n_entities"),
        F.lit(size["pct_total"]).alias("pct_total"),
        "feature",
        "position",
        "mean",
        ratio.alias("relative"),
    )
    return profiles.where(~F.col("cluster_id").isin(chosen)).unionByName(fresh.select(*profiles.columns))


def merged_top_features(merged: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    """Above = ratio > 1, below = 0 < ratio < 1, at most n each."""
    rated = merged.where(F.col("relative").isNotNull() & (F.col("relative") > 0))
    return top_features(rated, n, strict=True)


def flag(ratio: Column) -> Column:
    return F.when(ratio >= 2.0, "◀◀").when(ratio >= 1.4, "◀").otherwise("")


def evidence(profiles: DataFrame, above: int = 10, below: int = 5) -> DataFrame:
    """Ordered evidence entries per cluster: strongest features with mean, ratio and flag."""
    tops = top_features(profiles)
    entry = F.struct("rank", "feature", F.round("mean", 4).alias("mean"), "ratio", flag(F.col("ratio")).alias("flag"))

    def listed(side: str, limit: int) -> Column:
        return F.sort_array(F.collect_list(F.when((F.col("side") == side) & (F.col("rank") <= limit), entry)))

    return tops.groupBy("cluster_id", "n_entities", "pct_total").agg(listed("above", above).alias("above"), listed("below", below).alias("below"))


def text_evidence(terms: DataFrame, absent: DataFrame, representatives: DataFrame, n_terms: int = 12, n_absent: int = 6, n_docs: int = 3, chars: int = 280) -> DataFrame:
    """Distinctive terms, absent terms and short snippets per cluster."""
    t = terms.where(F.col("rank") <= n_terms).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "score"))).alias("terms"))
    a = absent.where(F.col("rank") <= n_absent).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "gap"))).alias("absent"))
    flat = F.trim(F.regexp_replace("document", "\n", " "))
    snippet = F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 3), F.lit("…"))).otherwise(flat)
    d = (
        representatives.where(F.col("rank") <= n_docs)
        .select("cluster_id", "rank", snippet.alias("snippet"))
        .groupBy("cluster_id")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "snippet"))), lambda x: x["snippet"]).alias("snippets"))
    )
    return t.join(a, "cluster_id", "full").join(d, "cluster_id", "full")


def by_parent(profiles: DataFrame, parents: DataFrame) -> DataFrame:
    """Top-level clusters, then groups of sub-clusters with summed size and share."""
    sizes = profiles.select("cluster_id", "n_entities", "pct_total").distinct()
    placed = sizes.join(parents.select("cluster_id", "parent"), "cluster_id", "left")
    return placed.groupBy("parent").agg(
        F.sort_array(F.collect_list("cluster_id")).alias("clusters"),
        F.sum("n_entities").alias("n_entities"),
        F.round(F.sum("pct_total"), 1).alias("pct_total"),
        F.count("*").alias("n_clusters"),
    )


def top_mean_columns(profiles: DataFrame, n: int = 3) -> DataFrame:
    """The columns with the largest means, as a short description of a cluster."""
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("mean"), "position"))
    return profiles.withColumn("rank", place).where(F.col("rank") <= n).select("cluster_id", "rank", "feature")


def member_samples(df: DataFrame, entity: str, profiles: DataFrame, n_rows: int = 3, n_features: int = 6, label: str = "cluster_id", seed: int = 42) -> DataFrame:
    """Up to three members per cluster, by seeded hash, with their values on its strongest features."""
    strongest = top_features(profiles, n_features).where("side = 'above'").groupBy("cluster_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("_f")
    )
    names = [r["feature"] for r in profiles.select("feature").distinct().collect()]
    order = Window.partitionBy(col(label)).orderBy(seeded_order(col(entity), seed=seed), col(entity))
    picked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_rows)
    values = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[col(c).cast("double") for c in names]))
    return picked.select(col(label).alias("cluster_id"), col(entity).alias("entity_id"), "rank", values.alias("_v")).join(
        F.broadcast(strongest), "cluster_id"
    ).select("cluster_id", "entity_id", "rank", F.transform("_f", lambda f: F.struct(f.alias("feature"), F.element_at("_v", f).alias("value"))).alias("values"))


# ---------------------------------------------------------------------------
# views for reviewers
# ---------------------------------------------------------------------------


def aliases(personas: DataFrame) -> DataFrame:
    """cluster_id -> "Group A", "Group B", ... in (length, id) order; letters repeat after 52."""
    text = F.col("cluster_id").cast("string")
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.length(text), text)) - 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return personas.select("cluster_id", F.concat(F.lit("Group "), F.substring(F.lit(letters), F.pmod(place, F.lit(52)) + 1, F.lit(1))).alias("alias"))


def statistical_view(profiles: DataFrame, personas: DataFrame, f1: DataFrame | None = None) -> DataFrame:
    """Sizes, F1 and ratios under aliases; no names."""
    above, below = 8, 5
    tops = top_features(profiles)

    def listed(side: str, limit: int) -> Column:
        entry = F.struct("rank", "feature", "ratio")
        ordered = F.sort_array(F.collect_list(F.when((F.col("side") == side) & (F.col("rank") <= limit), entry)))
        return F.transform(ordered, lambda x: F.struct(x["feature"].alias("feature"), x["ratio"].alias("ratio")))

    body = tops.groupBy("cluster_id", "n_entities", "pct_total").agg(listed("above", above).alias("above"), listed("below", below).alias("below"))
    view = body.join(aliases(personas), "cluster_id")
    if f1 is not None:
        scored = personas.select("cluster_id", "name").join(f1.select("name", F.round("f1", 3).alias("cv_f1")), "name", "left").select("cluster_id", "cv_f1")
        view = view.join(scored, "cluster_id", "left")
    else:
        view = view.withColumn("cv_f1", F.lit(None).cast("double"))
    return view.select("alias", "n_entities", "pct_total", "cv_f1", "above", "below")


def business_view(personas: DataFrame, chars: int = 200) -> DataFrame:
    """Names with a description of at most 200 characters, cut at a word."""
    source = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")).otherwise(F.coalesce("tagline", F.lit("")))
    text = F.regexp_replace(F.trim(source), "\n", " ")
    cut = F.concat(F.regexp_replace(F.substring(text, 1, chars - 3), r" [^ ]*$", ""), F.lit("…"))
    return personas.select("name", F.when(F.length(text) > chars, cut).otherwise(text).alias("description"))


def resolve_aliases(references: DataFrame, personas: DataFrame) -> DataFrame:
    """Map "Group A", "A" or a persona name in ``references.target`` back to a cluster id."""
    groups = aliases(personas)
    spellings = (
        groups.select(F.col("alias").alias("target"), "cluster_id", F.lit(0).alias("_o"))
        .unionByName(groups.select(F.element_at(F.split("alias", " "), -1).alias("target"), "cluster_id", F.lit(1).alias("_o")))
        .unionByName(personas.select(F.col("name").alias("target"), "cluster_id", F.lit(2).alias("_o")))
    )
    first = spellings.groupBy("target").agg(F.min_by("cluster_id", F.struct("_o", "cluster_id")).alias("cluster_id"))
    return references.join(F.broadcast(first), "target", "left")


# ---------------------------------------------------------------------------
# text clusters
# ---------------------------------------------------------------------------


def cluster_term_sums(weights: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, term, own, others): summed TF-IDF inside the cluster and in all the others.

    Dense over the bounded vocabulary, so that absent terms show up with zero.
    """
    own = weights.join(labels, "id").groupBy("cluster_id", "term").agg(F.sum("tfidf").alias("own"))
    total = own.groupBy("term").agg(F.sum("own").alias("total"))
    ids = [r["cluster_id"] for r in labels.select("cluster_id").distinct().orderBy("cluster_id").collect()]
    dense = total.withColumn("cluster_id", F.explode(F.array(*[F.lit(c) for c in ids])))
    filled = dense.join(own, ["cluster_id", "term"], "left").withColumn("own", F.coalesce("own", F.lit(0.0)))
    return filled.select("cluster_id", "term", "own", (F.col("total") - F.col("own")).alias("others"))


def distinctive_terms(sums: DataFrame, n_docs: int, n_clusters: int, top: int = TOP_TERMS) -> DataFrame:
    """own x ln(1 + average cluster size / (others + 1)), best first, positive only."""
    average = max(1.0, n_docs / max(n_clusters, 1))
    score = F.col("own") * F.log1p(F.lit(average) / (F.col("others") + 1.0))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("_s"), "term"))
    return sums.withColumn("_s", score).where("_s > 0").withColumn("rank", place).where(F.col("rank") <= top).select(
        "cluster_id", "rank", "term", F.round("_s", 4).alias("score")
    )


def absent_terms(sums: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Strong elsewhere, weak here: normalised gap above 0.1, largest first."""
    inside = Window.partitionBy("cluster_id")
    gap = F.col("others") / F.greatest(F.max("others").over(inside), F.lit(1e-9)) - F.col("own") / F.greatest(F.max("own").over(inside), F.lit(1e-9))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("_g"), "term"))
    return sums.withColumn("_g", gap).withColumn("rank", place).where((F.col("rank") <= top) & (F.col("_g") > 0.1)).select(
        "cluster_id", "rank", "term", F.round("_g", 4).alias("gap")
    )


def representative_documents(vectors: DataFrame, labels: DataFrame, documents: DataFrame | None = None, top: int = REPRESENTATIVES, chars: int = 400) -> DataFrame:
    """The documents closest to their cluster's mean direction (unit vectors: dot product = cosine)."""
    labelled = vectors.join(labels, "id")
    stats = cluster_stats(labelled)
    norm = np.linalg.norm(stats.centroids, axis=1, keepdims=True)
    directions = stats.centroids / np.where(norm == 0, 1.0, norm)
    table = vectors.sparkSession.createDataFrame([(c, [float(x) for x in d]) for c, d in zip(stats.labels, directions)], "cluster_id int, _d array<double>")
    dot = F.aggregate(F.zip_with("features", "_d", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    scored = labelled.join(F.broadcast(table), "cluster_id").select("cluster_id", "id", dot.alias("similarity"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("similarity"), "id"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= top)
    if documents is None:
        return best
    return documents.join(F.broadcast(best), "id").select("cluster_id", "rank", "id", "similarity", F.substring("document", 1, chars).alias("document"))


def pca_projection(df: DataFrame, entity: str, features: list[str], label: str = "cluster_id", sample: int = 1_500, seed: int = 42) -> DataFrame:
    """Two principal coordinates, fitted on all rows, of up to 1500 seeded-hash points (a plot sample)."""
    from cohortry.operators.cleaning import standardise

    values, vectors = np.linalg.eigh(standardised_covariance(df, features))
    axes = vectors[:, np.argsort(values)[::-1][:2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    scaled = standardise(df.select(col(entity), col(label), *[col(c).cast("double").alias(c) for c in features]), features)

    def along(j: int) -> Column:
        total = F.lit(0.0)
        for c, w in zip(features, axes[:, j]):
            total = total + col(c) * F.lit(float(w))
        return total

    picked = sample_rows(scaled, entity, n=sample, seed=seed)
    return picked.select(col(entity).alias("entity_id"), col(label).alias("cluster_id"), along(0).alias("x"), along(1).alias("y"))
