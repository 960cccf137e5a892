"""Feature scores, multicollinearity and agreement measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.catalog.features import ROLES
from cohortry.functions.algebra import standardised_covariance
from cohortry.operators import profiling, selection
from cohortry.plans.feature_plan import build_features

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIR = ["l_quantity", "l_extendedprice"]
TRIO = ["l_quantity", "l_extendedprice", "l_discount"]


def _scores(t: Tables):
    """PCA and reconstruction scores of the order features."""
    matrix = build_features(t.orders, ROLES, [{"builder": "overall_aggregate", "params": {"windows": [12, "all"]}}])
    names = [c for c in matrix.columns if c != "o_custkey"]
    cov = standardised_covariance(matrix, names)
    pca, recon = selection.pca_importance(cov, names), selection.reconstruction_error(cov, names, width=4)
    return t.spark.createDataFrame([(c, pca[c], recon[c]) for c in names], "feature string, pca_score double, recon_error double")


@query("L01_pca_importance")
def _(t: Tables):
    return rounded(_scores(t).select("feature", "pca_score"))


@query("L02_reconstruction_error")
def _(t: Tables):
    return rounded(_scores(t).select("feature", "recon_error"))


@query("L02_network_reconstruction_error")
def _(t: Tables):
    found = selection.network_reconstruction_error(t.lineitem, profiling.numeric_columns(t.lineitem))
    return rounded(t.spark.createDataFrame(list(found.items()), "feature string, recon_error double"))


# given scores: one per part type, so that the ranking itself can be stated in SQL
GIVEN = """g AS (SELECT p_brand AS feature, avg(p_retailprice) AS pca_score, avg(p_size) AS recon_error FROM part GROUP BY p_brand),
c AS (SELECT *, 0.5 * (pca_score - min(pca_score) OVER ()) / (max(pca_score) OVER () - min(pca_score) OVER ())
             + 0.5 * (recon_error - min(recon_error) OVER ()) / (max(recon_error) OVER () - min(recon_error) OVER ()) AS combined_score FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY combined_score DESC, feature) AS rank FROM c)"""


def _given(t: Tables):
    return t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("pca_score"), F.avg("p_size").alias("recon_error"))


@query("L03_combined_rank", f"WITH {GIVEN} SELECT feature, {r('combined_score')} AS combined_score, CAST(rank AS INT) AS rank FROM k")
def _(t: Tables):
    return rounded(selection.combined_rank(_given(t)).select("feature", "combined_score", F.col("rank").cast("int").alias("rank")))


@query("L04_prefilter", f"WITH {GIVEN} SELECT feature FROM k WHERE rank <= 10")
def _(t: Tables):
    return selection.prefilter(selection.combined_rank(_given(t)), 10).select("feature")


@query(
    "L05_vif_pair",
    " UNION ALL ".join(f"SELECT '{c}' AS feature, {r('1 / (1 - corr(l_quantity, l_extendedprice) ^ 2)')} AS vif FROM lineitem" for c in PAIR),
)
def _(t: Tables):
    return rounded(selection.compute_vif(t.lineitem, PAIR))


def _trio_vif(i: int) -> str:
    a, b = [x for x in range(3) if x != i]
    names = {(0, 1): "rqe", (0, 2): "rqd", (1, 2): "red"}
    pick = lambda x, y: names[tuple(sorted((x, y)))]
    ya, yb, ab = pick(i, a), pick(i, b), pick(a, b)
    r2 = f"({ya}^2 + {yb}^2 - 2 * {ya} * {yb} * {ab}) / (1 - {ab}^2)"
    return f"SELECT '{TRIO[i]}' AS feature, {r(f'1 / (1 - {r2})')} AS vif FROM m"


@query(
    "L05_vif_three",
    "WITH m AS (SELECT corr(l_quantity, l_extendedprice) AS rqe, corr(l_quantity, l_discount) AS rqd, corr(l_extendedprice, l_discount) AS red FROM lineitem) "
    + " UNION ALL ".join(_trio_vif(i) for i in range(3)),
)
def _(t: Tables):
    return rounded(selection.compute_vif(t.lineitem, TRIO))


def _collinear(t: Tables):
    """x, 2x+1, y, x+y, a constant and an unrelated column."""
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    return t.lineitem.select(
        x.alias("x"), (2 * x + 1).alias("x2"), y.alias("y"), (x + y).alias("xy"), F.lit(3.0).alias("flat"), F.col("l_tax").alias("noise")
    )


@query("L06_rank_pass", "SELECT 3 AS n_independent, 3 AS n_dependent, TRUE AS flat_dropped FROM (SELECT count(*) FROM lineitem)")
def _(t: Tables):
    from cohortry.functions.algebra import dependent_columns, triangular_factor
    from cohortry.operators.cleaning import standardise

    df = _collinear(t)
    gone = dependent_columns(triangular_factor(standardise(df, df.columns), df.columns), df.columns)
    return t.spark.createDataFrame([(len(df.columns) - len(gone), len(gone), "flat" in gone)], "n_independent int, n_dependent int, flat_dropped boolean")


@query("L07_remove_high_vif", "SELECT 3 AS n_kept, 3 AS n_removed, TRUE AS all_below FROM (SELECT count(*) FROM lineitem)")
def _(t: Tables):
    kept, removed, vif = selection.remove_high_vif(_collinear(t), ["x", "x2", "y", "xy", "flat", "noise"], min_features=2)
    return t.spark.createDataFrame([(len(kept), len(removed), max(vif.values()) <= 10)], "n_kept int, n_removed int, all_below boolean")


@query("L07_remove_high_vif_features")
def _(t: Tables):
    matrix = build_features(t.orders, ROLES, [{"builder": "overall_aggregate", "params": {"windows": [12, "all"]}}])
    names = [c for c in matrix.columns if c != "o_custkey"]
    kept, removed, vif = selection.remove_high_vif(matrix, names)
    rows = [(n, "kept", float(vif[n])) for n in kept] + [(n, "removed", None) for n in removed]
    return rounded(t.spark.createDataFrame(rows, "feature string, fate string, vif double"), 4)


def _pairs_sql() -> str:
    parts = []
    for i, a in enumerate(NUMBERS):
        for b in NUMBERS[i + 1 :]:
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(abs(corr({a}, {b})), 4) AS correlation FROM lineitem HAVING abs(corr({a}, {b})) >= 0.002")
    return " UNION ALL ".join(parts)


@query("L08_high_correlations", _pairs_sql())
def _(t: Tables):
    return selection.high_correlations(t.lineitem, NUMBERS, 0.002)


def _anova_sql() -> str:
    parts = []
    for c in NUMBERS:
        parts.append(
            f"""SELECT '{c}' AS feature, {r('(ssb / (k - 1)) / (ssw / (n - k))')} AS f_stat FROM (
            SELECT count(*) AS k, sum(n) AS n, sum(n * (m - g) * (m - g)) AS ssb, sum(n * v) AS ssw FROM (
              SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM lineitem) AS g FROM lineitem GROUP BY l_suppkey))"""
        )
    return " UNION ALL ".join(parts)


@query("L09_anova", _anova_sql())
def _(t: Tables):
    return rounded(selection.anova(t.lineitem, NUMBERS, "l_suppkey").select("feature", "f_stat"))


@query("L10_select_features")
def _(t: Tables):
    matrix = build_features(t.orders, ROLES)
    chosen = selection.select_features(matrix, "o_custkey")
    return chosen.ranking.withColumn("selected", F.col("feature").isin(chosen.selected))


@query(
    "L10_default_request",
    f"""WITH {GIVEN}, p AS (SELECT a.feature AS fa, b.feature AS fb, a.rank AS ra, b.rank AS rb FROM k a JOIN k b ON b.rank = a.rank + 1 AND a.rank % 3 = 1)
        SELECT feature FROM k WHERE feature NOT IN (SELECT CASE WHEN ra > rb THEN fa ELSE fb END FROM p) ORDER BY rank LIMIT 55""",
)
def _(t: Tables):
    ranked = selection.combined_rank(_given(t)).select("feature", "rank")
    nxt = ranked.select(F.col("feature").alias("feature_b"), (F.col("rank") - 1).alias("rank"))
    pairs = ranked.where("rank % 3 = 1").withColumnRenamed("feature", "feature_a").join(nxt, "rank").select("feature_a", "feature_b")
    return selection.default_request(ranked, pairs).select("feature")


@query(
    "L12_text_keeps_all",
    f"""WITH u AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
        SELECT 'emb_' || CAST(pos AS VARCHAR) AS feature, count(*) AS n, {r('avg(x)')} AS mean, {r('max(x)')} AS top FROM u GROUP BY pos""",
)
def _(t: Tables):
    """Every dimension of the text vectors stays, with its values."""
    wide = t.embeddings.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"emb_{i}") for i in range(64)])
    kept = selection.select_features(wide, "vec_id", modality="text").selected
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in kept])).alias("c")
    return rounded(wide.select(cells).groupBy("c.feature").agg(F.count("c.x").alias("n"), F.avg("c.x").alias("mean"), F.max("c.x").alias("top")))


@query("P18_explained_variance")
def _(t: Tables):
    values = selection.explained_variance(t.lineitem, profiling.numeric_columns(t.lineitem))
    return t.spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "component int, ratio double")


# labels cover some documents: the joined columns have gaps
def _labelled(t: Tables):
    return t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "quality", "toxic"), "doc_id", "left")


_GAPS = "d AS (SELECT documents.doc_id, n_chars, quality, toxic FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id), c AS (SELECT * FROM d WHERE quality IS NOT NULL AND n_chars IS NOT NULL)"


@query(
    "P18_explained_variance_with_gaps",
    f"""WITH {_GAPS}, v AS (SELECT abs(corr(n_chars, quality)) AS a FROM c)
        SELECT 1 AS component, {r('round((1 + a) / 2, 4)', 4)} AS ratio FROM v UNION ALL SELECT 2, {r('round((1 - a) / 2, 4)', 4)} FROM v""",
)
def _(t: Tables):
    values = selection.explained_variance(_labelled(t), ["n_chars", "quality"])
    return rounded(t.spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "component int, ratio double"), 4)


@query(
    "L05_vif_with_gaps",
    f"""WITH {_GAPS}, x AS (SELECT corr(doc_id, n_chars) AS a FROM d)
        SELECT 'doc_id' AS feature, {r('1 / (1 - a ^ 2)')} AS vif FROM x UNION ALL SELECT 'n_chars', {r('1 / (1 - a ^ 2)')} FROM x""",
)
def _(t: Tables):
    return rounded(selection.compute_vif(_labelled(t), ["doc_id", "n_chars", "quality", "toxic"]))


@query(
    "L08_high_correlations_with_gaps",
    f"""WITH {_GAPS}, p AS (SELECT 'n_chars' AS feature_a, 'quality' AS feature_b, corr(n_chars, quality) AS v FROM c UNION ALL SELECT 'n_chars', 'toxic', corr(n_chars, toxic) FROM c
          UNION ALL SELECT 'quality', 'toxic', corr(quality, toxic) FROM c)
        SELECT feature_a, feature_b, {r('round(abs(v), 4)', 4)} AS correlation FROM p""",
)
def _(t: Tables):
    return rounded(selection.high_correlations(_labelled(t), ["n_chars", "quality", "toxic"], 0.0), 4)
