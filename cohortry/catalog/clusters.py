"""Clustering algorithms, searches, refinement and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.functions.vectors import cluster_stats, points
from cohortry.operators import metrics, refine, search
from cohortry.operators.clustering import dbscan, fuzzy_c_means, gaussian_mixture, kmeans, ward
from cohortry.operators.clustering.density import neighbour_counts

# unnested embeddings with their label
EMB = """u AS (SELECT vec_id AS id, label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cen AS (SELECT label, pos, avg(x) AS c, count(*) AS n FROM u GROUP BY label, pos),
siz AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""


def embedded(t: Tables) -> DataFrame:
    """id, features and the given label as cluster."""
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").alias("cluster_id")
    )


def customers(t: Tables) -> DataFrame:
    """Per customer: orders, mean price (in 100 000) and balance (in 1000) as a point."""
    spend = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        (F.count("*") / 5.0).alias("a"), (F.avg("o_totalprice") / 50_000).alias("b")
    )
    return points(t.customer.join(spend, "c_custkey").withColumn("c", F.col("c_acctbal") / 2_000), "c_custkey", ["a", "b", "c"])


def shape(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("K01_kmeans")
def _(t: Tables):
    return shape(kmeans(customers(t), 4, restarts=15))


@query("K01_kmeans_cosine")
def _(t: Tables):
    return shape(kmeans(embedded(t).select("id", "features"), 10, restarts=15, metric="cosine"))


@query("K02_ward")
def _(t: Tables):
    return shape(ward(customers(t), 4))


EPS, NEED = 0.12, 8
CELLS = f"""p AS (SELECT c_custkey AS id, a, b, c_acctbal / 2000 AS c FROM customer JOIN
  (SELECT o_custkey, count(*) / 5.0 AS a, avg(o_totalprice) / 50000 AS b FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey),
nb AS (SELECT x.id, count(*) AS neighbours FROM p x JOIN p y ON abs(x.a - y.a) <= {EPS} AND abs(x.b - y.b) <= {EPS} AND abs(x.c - y.c) <= {EPS}
   AND (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) <= {EPS * EPS!r} GROUP BY x.id)"""


@query("K03_neighbour_counts", f"WITH {CELLS} SELECT id, neighbours, neighbours >= {NEED} AS core FROM nb")
def _(t: Tables):
    return neighbour_counts(customers(t), EPS, NEED).select(F.col("rep").alias("id"), "neighbours", "core")


@query(
    "K03_dbscan",
    f"""WITH RECURSIVE {CELLS},
    core AS (SELECT p.* FROM p JOIN nb ON nb.id = p.id WHERE neighbours >= {NEED}),
    edge AS (SELECT x.id AS a, y.id AS b FROM core x JOIN core y ON abs(x.a - y.a) <= {EPS} AND abs(x.b - y.b) <= {EPS} AND abs(x.c - y.c) <= {EPS}
       AND (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) <= {EPS * EPS!r}),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT edge.b, reach.root FROM reach JOIN edge ON edge.a = reach.id),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
    num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM (SELECT DISTINCT root FROM comp)),
    bord AS (SELECT x.id, min(num.k) AS k FROM p x JOIN core y ON abs(x.a - y.a) <= {EPS} AND abs(x.b - y.b) <= {EPS} AND abs(x.c - y.c) <= {EPS}
       AND (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) <= {EPS * EPS!r}
       JOIN comp ON comp.id = y.id JOIN num ON num.root = comp.root GROUP BY x.id)
    SELECT p.id, CAST(coalesce(num.k, bord.k, (SELECT count(*) FROM num)) AS INT) AS cluster_id FROM p
    LEFT JOIN comp ON comp.id = p.id LEFT JOIN num ON num.root = comp.root LEFT JOIN bord ON bord.id = p.id""",
)
def _(t: Tables):
    return dbscan(customers(t), EPS, NEED)


@query("K04_gaussian_mixture")
def _(t: Tables):
    return shape(gaussian_mixture(customers(t), 3, restarts=5))


@query("K05_fuzzy_c_means")
def _(t: Tables):
    return shape(fuzzy_c_means(customers(t), 4))


@query("K08_optimise_k")
def _(t: Tables):
    return rounded(search.optimise_k(customers(t), "kmeans"), 4)


# a table of measures per k, derived from the parts: size plays k
MEASURES = """m AS (SELECT p_size AS k, avg(p_retailprice) / 2000 AS silhouette, stddev_pop(p_retailprice) / 200 AS davies_bouldin,
  max(p_retailprice) AS calinski_harabasz, sum(p_retailprice) * exp(-p_size / 10.0) AS inertia FROM part GROUP BY p_size)"""
ELBOW = """l AS (SELECT k, lag(ln(inertia)) OVER (ORDER BY k) AS a, ln(inertia) AS b, lead(ln(inertia)) OVER (ORDER BY k) AS c FROM m),
 e AS (SELECT k, CASE WHEN a IS NULL OR c IS NULL THEN 0.0 ELSE greatest(0.0, a - 2 * b + c) END AS v FROM l),
 el AS (SELECT k, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS elbow FROM e)"""


def measures(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    return t.part.groupBy(F.col("p_size").alias("k")).agg(
        (F.avg(price) / 2000).alias("silhouette"), (F.stddev_pop(price) / 200).alias("davies_bouldin"), F.max(price).alias("calinski_harabasz"),
        F.sum(price).alias("s"),
    ).select("k", "silhouette", "davies_bouldin", "calinski_harabasz", (F.col("s") * F.exp(-F.col("k") / 10.0)).alias("inertia"))


@query(
    "K08_composite",
    f"""WITH {MEASURES}, {ELBOW}, c AS (SELECT m.k,
      0.40 * (silhouette - min(silhouette) OVER ()) / (max(silhouette) OVER () - min(silhouette) OVER ())
      + 0.25 * (max(davies_bouldin) OVER () - davies_bouldin) / (max(davies_bouldin) OVER () - min(davies_bouldin) OVER ())
      + 0.25 * (calinski_harabasz - min(calinski_harabasz) OVER ()) / (max(calinski_harabasz) OVER () - min(calinski_harabasz) OVER ())
      + 0.10 * elbow AS composite FROM m JOIN el ON el.k = m.k)
    SELECT k, {r('composite')} AS composite, row_number() OVER (ORDER BY composite DESC, k) = 1 AS best FROM c""",
)
def _(t: Tables):
    return rounded(search.k_composite(measures(t)).select("k", "composite", "best"))


@query("K09_elbow", f"WITH {MEASURES}, {ELBOW} SELECT k, {r('elbow')} AS elbow FROM el")
def _(t: Tables):
    return rounded(search.elbow_scores(measures(t)))


@query(
    "K10_candidate_scores",
    f"""WITH {MEASURES}, c AS (SELECT k, silhouette, k / 50.0 AS stability_ari, davies_bouldin, calinski_harabasz, 0.2 + k / 100.0 AS max_cluster_pct FROM m),
    s AS (SELECT k, round(greatest(0, silhouette) * 45 + stability_ari * 25 + greatest(0, 1 - davies_bouldin / 3) * 15 + least(1, calinski_harabasz / 500) * 15
       - greatest(0, max_cluster_pct - 0.4) * 50, 4) AS composite_score FROM c)
    SELECT k, composite_score FROM s ORDER BY composite_score DESC, k LIMIT 8""",
)
def _(t: Tables):
    table = measures(t).select(
        F.col("k").alias("seq"), F.lit("kmeans").alias("algorithm"), "k", "silhouette", (F.col("k") / 50.0).alias("stability_ari"), "davies_bouldin",
        "calinski_harabasz", (0.2 + F.col("k") / 100.0).alias("max_cluster_pct"),
    )
    return search.rank_candidates(table).select("k", "composite_score")


@query("K10_tournament")
def _(t: Tables):
    return rounded(search.tournament(customers(t), search.TOURNAMENT), 4)


@query("K11_stability")
def _(t: Tables):
    data = customers(t).persist()
    value = search.stability("kmeans", data, kmeans(data, 4), 4)
    return t.spark.createDataFrame([(value,)], "stability_ari double")


@query(
    "K12_valid_labels",
    f"""SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_rows, count(*) >= 2 AND count(*) < sum(n) AS valid, {r('max(n) * 1.0 / sum(n)')} AS max_cluster_pct
        FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)""",
)
def _(t: Tables):
    return rounded(metrics.valid_labels(t.customer, "c_nationkey"))


@query("K14_deepen")
def _(t: Tables):
    data = customers(t)
    labels = data.select("id", F.when(F.element_at("features", 1) > 1, 0).otherwise(1).alias("cluster_id"))
    placed, tree = refine.deepen(data, labels, "kmeans", cap=0.4, sub_k=3, max_depth=2)
    return tree.table(t.spark).select("cluster_id", "parent", "depth", "pct_total", "pct_of_parent")


@query(
    "K15_first_merge",
    """WITH c AS (SELECT n_regionkey * 10 + c_nationkey AS k, count(*) AS n, avg(c_acctbal) AS x, avg(c_custkey) / 100.0 AS y FROM customer JOIN nation ON n_nationkey = c_nationkey
         GROUP BY ALL), lim AS (SELECT quantile_disc(n, 0.3) AS need FROM c),
       src AS (SELECT * FROM c WHERE n < (SELECT need FROM lim) ORDER BY n, k LIMIT 1)
       SELECT src.k AS "from", (SELECT k FROM c WHERE n >= (SELECT need FROM lim) ORDER BY (c.x - src.x) ^ 2 + (c.y - src.y) ^ 2, k LIMIT 1) AS "to", src.n AS n_moved FROM src""",
)
def _(t: Tables):
    nations = t.nation.select("n_nationkey", "n_regionkey")
    placed = t.customer.join(F.broadcast(nations), F.col("n_nationkey") == F.col("c_nationkey"))  # nation is a fixed list of 25 rows
    body = placed.select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal", F.col("c_custkey") / 100.0).alias("features"), (F.col("n_regionkey") * 10 + F.col("c_nationkey")).alias("cluster_id")
    )
    stats = cluster_stats(body)
    sizes = {int(c): int(n) for c, n in zip(stats.labels, stats.n)}
    ordered = sorted(sizes.values())
    need = ordered[max(0, -(-3 * len(ordered) // 10) - 1)]
    first = refine.merge_plan(sizes, dict(zip(sizes, stats.centroids)), need)[:1]
    return t.spark.createDataFrame([(s["from"], s["to"], s["n_moved"]) for s in first], "from int, to int, n_moved long")


@query("K15_merge_tiny")
def _(t: Tables):
    data = customers(t)
    labels = data.select("id", F.least(F.floor(F.element_at("features", 1) * 5), F.lit(30)).cast("int").alias("cluster_id"))
    tree = refine.start_lineage(refine.sizes_of(labels))
    merged, _steps = refine.merge_tiny(data, labels, tree, min_size=40)
    return shape(merged)


@query(
    "K16_lineage",
    """WITH s AS (SELECT c_nationkey AS k, n_regionkey + 100 AS parent, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
       f AS (SELECT parent, list_sort(list(k)) AS family, sum(n) AS np FROM s GROUP BY parent)
       SELECT s.k AS cluster_id, s.parent, 1 AS depth, array_to_string(list_filter(family, lambda x: x <> s.k), ',') AS siblings,
              round(n * 1.0 / (SELECT sum(n) FROM s), 3) AS pct_total, round(n * 1.0 / np, 3) AS pct_of_parent FROM s JOIN f ON f.parent = s.parent""",
)
def _(t: Tables):
    parents = t.nation.select(F.col("n_nationkey").alias("cluster_id"), (F.col("n_regionkey") + 100).alias("parent"))
    out = refine.lineage_from_parents(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster_id")), parents)
    return out.withColumn("siblings", F.array_join("siblings", ","))


@query(
    "K16_leaves",
    """SELECT n_nationkey AS cluster_id FROM nation WHERE n_nationkey % 7 <> 0
       UNION ALL SELECT r_regionkey + 100 FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)""",
)
def _(t: Tables):
    children = t.nation.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("split_into"))
    tops = t.region.join(children, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        (F.col("r_regionkey") + 100).alias("cluster_id"), "split_into", F.lit(None).cast("int").alias("merged_into")
    )
    subs = t.nation.select(
        F.col("n_nationkey").alias("cluster_id"), F.lit(None).cast("array<int>").alias("split_into"), F.when(F.col("n_nationkey") % 7 == 0, F.lit(1)).alias("merged_into")
    )
    return refine.lineage_leaves(tops.unionByName(subs)).select("cluster_id")


@query(
    "K17_quality_gate",
    """WITH c AS (SELECT p_brand AS clustering, avg(p_size) / 50 AS silhouette, count(DISTINCT p_type) AS n_labels FROM part GROUP BY p_brand
         UNION ALL SELECT p_name, (min(p_size) - 1.0) / 20, 1 FROM part GROUP BY p_name)
       SELECT clustering, CASE WHEN silhouette >= 0.5 THEN 'strong' WHEN silhouette >= 0.25 THEN 'reasonable' WHEN silhouette >= 0.1 THEN 'weak but usable' ELSE 'low' END AS quality,
         CASE WHEN n_labels < 2 OR silhouette < 0.2 THEN 'blocked' WHEN silhouette >= 0.5 THEN 'success' ELSE 'warning' END AS status,
         CASE WHEN n_labels < 2 OR silhouette < 0.2 THEN 'reselect_features' ELSE 'proceed' END AS action FROM c""",
)
def _(t: Tables):
    brands = t.part.groupBy(F.col("p_brand").alias("clustering")).agg((F.avg("p_size") / 50).alias("silhouette"), F.count_distinct("p_type").alias("n_labels"))
    names = t.part.groupBy(F.col("p_name").alias("clustering")).agg(((F.min("p_size") - 1.0) / 20).alias("silhouette")).withColumn("n_labels", F.lit(1).cast("long"))
    return refine.clustering_gate(brands.unionByName(names), 0.2, 0.5).select("clustering", "quality", "status", "action")


# -- measures given labels ------------------------------------------------------


@query(
    "M01_silhouette_euclidean",
    f"""WITH e AS (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
    d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
    ab AS (SELECT id, label, sum(s / n) FILTER (WHERE label = other) AS a, min(s / n) FILTER (WHERE label <> other) AS b FROM d GROUP BY ALL)
    SELECT id, {r('CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END', 5)} AS silhouette FROM ab""",
)
def _(t: Tables):
    return rounded(metrics.silhouette_points(embedded(t)).select("id", "silhouette"), 5)


@query("M01_silhouette_sampled")
def _(t: Tables):
    points_of = metrics.silhouette_points(embedded(t), sample=200)
    return rounded(points_of.agg(F.count("*").alias("n_evaluated"), F.avg("silhouette").alias("silhouette")), 5)


@query(
    "M02_silhouette_cosine",
    f"""WITH e AS (SELECT vec_id AS id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
    d AS (SELECT a.id, a.label, b.label AS other, sum(1 - list_cosine_similarity(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
    ab AS (SELECT id, label, sum(s / n) FILTER (WHERE label = other) AS a, min(s / n) FILTER (WHERE label <> other) AS b FROM d GROUP BY ALL)
    SELECT {r('avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END)', 5)} AS silhouette FROM ab""",
)
def _(t: Tables):
    value = metrics.silhouette(embedded(t), metric="cosine")
    return rounded(t.spark.createDataFrame([(float(value),)], "silhouette double"), 5)


@query(
    "M03_davies_bouldin_calinski_harabasz",
    f"""WITH {EMB},
    dist AS (SELECT u.id, u.label, sqrt(sum((x - c) ^ 2)) AS d FROM u JOIN cen ON cen.label = u.label AND cen.pos = u.pos GROUP BY ALL),
    sp AS (SELECT label, avg(d) AS s FROM dist GROUP BY label),
    cc AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) ^ 2)) AS m FROM cen a JOIN cen b ON a.pos = b.pos AND a.label <> b.label GROUP BY ALL),
    db AS (SELECT i, max((x.s + y.s) / m) AS r FROM cc JOIN sp x ON x.label = i JOIN sp y ON y.label = j GROUP BY i),
    g AS (SELECT pos, avg(x) AS g FROM u GROUP BY pos),
    ssb AS (SELECT sum(n * (c - g) ^ 2) AS v FROM cen JOIN g ON g.pos = cen.pos),
    ssw AS (SELECT sum((x - c) ^ 2) AS v FROM u JOIN cen ON cen.label = u.label AND cen.pos = u.pos)
    SELECT {r('(SELECT avg(r) FROM db)', 5)} AS davies_bouldin,
           {r('(SELECT v FROM ssb) / (SELECT v FROM ssw) * ((SELECT count(*) FROM embeddings) - (SELECT count(*) FROM siz)) / ((SELECT count(*) FROM siz) - 1)', 5)} AS calinski_harabasz""",
)
def _(t: Tables):
    db, ch = metrics.davies_bouldin_calinski_harabasz(embedded(t))
    return rounded(t.spark.createDataFrame([(db, ch)], "davies_bouldin double, calinski_harabasz double"), 5)


@query(
    "M04_adjusted_rand",
    f"""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY ALL),
    s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS t FROM c),
    sa AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), sb AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b))
    SELECT {r('(s.s - sa.s * sb.s / (s.t * (s.t - 1) / 2.0)) / ((sa.s + sb.s) / 2.0 - sa.s * sb.s / (s.t * (s.t - 1) / 2.0))')} AS ari FROM s, sa, sb""",
)
def _(t: Tables):
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("id")
    rows = t.lineitem.select(key, "l_returnflag", "l_linestatus")
    cells = rows.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    return rounded(metrics.adjusted_rand(cells))


@query(
    "M04_contingency",
    "SELECT c_nationkey AS a, CAST(floor(c_acctbal / 2500) AS BIGINT) AS b, count(*) AS n FROM customer GROUP BY ALL",
)
def _(t: Tables):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster_id"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 2500).alias("cluster_id"))
    return metrics.contingency(a, b)


@query(
    "M05_purity",
    f"SELECT {r('sum(best) * 1.0 / sum(n)')} AS purity FROM (SELECT source, max(n) AS best, sum(n) AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source)",
)
def _(t: Tables):
    return rounded(metrics.purity(t.documents, "source", "lang"))


# run table: one run per brand with an F1, a silhouette and a VIF derived from its parts
RUN_ROWS = """runs AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS iteration, avg(p_size) / 50 AS f1, (avg(p_retailprice) - 900) / 1200 - 0.02 AS sil,
   stddev_pop(p_size) AS vif FROM part GROUP BY p_brand), sc AS (SELECT iteration, greatest(0, f1) * 100 + greatest(0, sil) * 30 - log10(greatest(1, vif)) * 5 AS score FROM runs)"""


def run_rows(t: Tables) -> DataFrame:
    return t.part.groupBy(F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("iteration")).agg(
        (F.avg("p_size") / 50).alias("f1"), ((F.avg("p_retailprice") - 900) / 1200 - 0.02).alias("sil"), F.stddev_pop("p_size").alias("vif")
    )


@query("M06_run_score", f"WITH {RUN_ROWS} SELECT iteration, {r('score')} AS score FROM sc")
def _(t: Tables):
    return rounded(run_rows(t).select("iteration", metrics.run_score(F.col("f1"), F.col("sil"), F.col("vif")).alias("score")))


@query("M07_best_iteration", f"WITH {RUN_ROWS} SELECT iteration, {r('score')} AS score FROM sc ORDER BY score DESC, iteration LIMIT 1")
def _(t: Tables):
    scored = run_rows(t).select("iteration", metrics.run_score(F.col("f1"), F.col("sil"), F.col("vif")).alias("score"))
    return rounded(metrics.best_iteration(scored))
