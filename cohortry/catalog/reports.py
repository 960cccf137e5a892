"""Cluster profiles, evidence views, persona gate and classifier check, on customers grouped by nation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.operators import naming, profiles, validation
from cohortry.sources import sinks

# feature -> (SQL aggregate, Spark aggregate)
FEATURES = {
    "n_orders": ("CAST(count(o_orderkey) AS DOUBLE)", lambda: F.count("o_orderkey").cast("double")),
    "total": ("coalesce(sum(o_totalprice), 0)", lambda: F.coalesce(F.sum("o_totalprice"), F.lit(0.0))),
    "mean_price": ("coalesce(avg(o_totalprice), 0)", lambda: F.coalesce(F.avg("o_totalprice"), F.lit(0.0))),
    "max_price": ("coalesce(max(o_totalprice), 0)", lambda: F.coalesce(F.max("o_totalprice"), F.lit(0.0))),
    "min_price": ("coalesce(min(o_totalprice), 0)", lambda: F.coalesce(F.min("o_totalprice"), F.lit(0.0))),
    "n_urgent": ("CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE)", lambda: _count_if("o_orderpriority", "1-URGENT")),
    "n_high": ("CAST(count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS DOUBLE)", lambda: _count_if("o_orderpriority", "2-HIGH")),
    "n_medium": ("CAST(count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS DOUBLE)", lambda: _count_if("o_orderpriority", "3-MEDIUM")),
    "n_low": ("CAST(count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS DOUBLE)", lambda: _count_if("o_orderpriority", "5-LOW")),
    "n_open": ("CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE)", lambda: _count_if("o_orderstatus", "O")),
    "n_final": ("CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE)", lambda: _count_if("o_orderstatus", "F")),
    "balance": ("max(c_acctbal)", lambda: F.max("c_acctbal")),
}


def _count_if(column: str, value: str):
    return F.count(F.when(F.col(column) == value, 1)).cast("double")


NAMES = list(FEATURES)

CF = f"""cf AS (SELECT c_custkey AS id, c_nationkey AS cluster_id, {', '.join(f'{e[0]} AS {n}' for n, e in FEATURES.items())}
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey)"""
_long = " UNION ALL ".join(
    f"SELECT cluster_id, count(*) AS n_entities, '{f}' AS feature, {i} AS position, avg({f}) AS mean, (SELECT avg({f}) FROM cf) AS g FROM cf GROUP BY cluster_id"
    for i, f in enumerate(NAMES)
)
PR = f"""{CF}, lo AS ({_long}),
pr AS (SELECT cluster_id, n_entities, round(n_entities * 100.0 / (SELECT count(*) FROM cf), 1) AS pct_total, feature, position, mean, coalesce(mean / nullif(g, 0), 1.0) AS relative FROM lo)"""
TOP = f"""{PR}, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY relative DESC, position) AS hi, row_number() OVER (PARTITION BY cluster_id ORDER BY relative, position) AS lw FROM pr),
tp AS (SELECT cluster_id, n_entities, pct_total, 'above' AS side, hi AS rank, feature, mean, relative, round(relative, 2) AS ratio FROM rk WHERE hi <= 10
  UNION ALL SELECT cluster_id, n_entities, pct_total, 'below', lw, feature, mean, relative, round(relative, 2) FROM rk WHERE lw <= 10)"""
PE = f"""{TOP}, pe AS (SELECT n_nationkey AS cluster_id, n_name AS name, r_name AS region, n_regionkey, 5.0 + n_regionkey AS confidence,
  'Customers of ' || n_name || ' in ' || r_name || ' led by ' || (SELECT feature FROM tp WHERE tp.cluster_id = n_nationkey AND side = 'above' AND rank = 1)
    || ' then ' || (SELECT feature FROM tp WHERE tp.cluster_id = n_nationkey AND side = 'above' AND rank = 2) AS description
  FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def customer_features(t: Tables) -> DataFrame:
    joined = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.groupBy(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster_id")).agg(*[e[1]().alias(n) for n, e in FEATURES.items()])


def nation_profiles(t: Tables) -> DataFrame:
    return profiles.cluster_profiles(customer_features(t), NAMES)


def personas(t: Tables) -> DataFrame:
    """A persona per nation: name, description and the three strongest features come from the tables."""
    tops = profiles.top_features(nation_profiles(t)).where("side = 'above'")
    listed = tops.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("f"))
    nations = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    body = nations.join(listed, F.col("cluster_id") == F.col("n_nationkey"))
    told = F.concat(
        F.lit("Customers of "), F.col("n_name"), F.lit(" in "), F.col("r_name"), F.lit(" led by "), F.element_at("f", 1), F.lit(" then "), F.element_at("f", 2)
    )
    return body.select(
        "cluster_id",
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("tagline"),
        told.alias("description"),
        F.slice("f", 1, 3).alias("dominant_features"),
        F.array("r_name").alias("traits"),
        (5.0 + F.col("n_regionkey")).alias("confidence"),
    )


# -- profiles -------------------------------------------------------------------


@query(
    "R01_cluster_profiles",
    f"WITH {PR} SELECT cluster_id, n_entities, CAST(pct_total AS DOUBLE) AS pct_total, feature, {r('mean', 3)} AS mean, {r('relative', 3)} AS relative FROM pr",
)
def _(t: Tables):
    return rounded(nation_profiles(t).select("cluster_id", "n_entities", "pct_total", "feature", "mean", "relative"), 3)


@query("R02_top_features", f"WITH {TOP} SELECT cluster_id, side, CAST(rank AS INT) AS rank, feature, {r('relative', 5)} AS relative FROM tp")
def _(t: Tables):
    tops = profiles.top_features(nation_profiles(t))
    return rounded(tops.select("cluster_id", "side", F.col("rank").cast("int").alias("rank"), "feature", "relative"), 5)


SIGNAL = "CASE WHEN ratio >= 2.0 THEN 'STRONG_ABOVE_2x' WHEN ratio >= 1.4 THEN 'ABOVE_1.4x' WHEN ratio >= 1.0 THEN 'MODERATE_ABOVE' WHEN ratio >= 0.6 THEN 'NEUTRAL' ELSE 'BELOW' END"


@query(
    "R06_signal_buckets",
    f"WITH {TOP} SELECT signal, count(*) AS n FROM (SELECT {SIGNAL} AS signal FROM (SELECT ratio * 1.6 - 0.4 AS ratio FROM tp)) GROUP BY signal",
)
def _(t: Tables):
    tops = profiles.top_features(nation_profiles(t))
    return tops.groupBy(profiles.signal(F.col("ratio") * 1.6 - 0.4).alias("signal")).agg(F.count("*").alias("n"))


@query(
    "S08_report_rows",
    f"""WITH {PE} SELECT pr.cluster_id, any_value(n_entities) AS n_entities, any_value(pe.name) AS name, count(*) AS n_means FROM pr LEFT JOIN pe ON pe.cluster_id = pr.cluster_id
        GROUP BY pr.cluster_id""",
)
def _(t: Tables):
    named = personas(t)
    docs = sinks.report_rows(profiles.profile_documents(nation_profiles(t)), named)
    parsed = F.from_json("document", "cluster_stats struct<n_entities:long,feature_means:map<string,double>>, persona struct<name:string>")
    return docs.select("cluster_id", parsed.alias("d")).select(
        "cluster_id", "d.cluster_stats.n_entities", "d.persona.name", F.size("d.cluster_stats.feature_means").cast("long").alias("n_means")
    )


@query("S08_top_importances", f"WITH {PR} SELECT feature, {r('max(relative)', 4)} AS importance FROM pr GROUP BY feature ORDER BY max(relative) DESC LIMIT 5")
def _(t: Tables):
    table = nation_profiles(t).groupBy("feature").agg(F.max("relative").alias("importance"))
    return rounded(sinks.top_importances(table, 5), 4)


@query(
    "S09_metrics_table",
    f"""WITH {PE} SELECT DISTINCT tp.cluster_id, CASE WHEN n_regionkey = 0 THEN 'Cluster ' || CAST(tp.cluster_id AS VARCHAR) ELSE pe.name END AS persona_name, n_entities,
        {r('pct_total / 100', 4)} AS pct_of_total, feature, {r('round(mean, 4)', 3)} AS mean_value, {r('ratio', 4)} AS relative_to_avg, {SIGNAL} AS signal
        FROM tp JOIN pe ON pe.cluster_id = tp.cluster_id""",
)
def _(t: Tables):
    some = t.nation.where("n_regionkey <> 0").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    return rounded(rounded(profiles.metrics_table(nation_profiles(t), some), 4, ["pct_of_total", "relative_to_avg"]), 3, ["mean_value"])


@query(
    "R07_size_check",
    f"""WITH {PR} SELECT DISTINCT cluster_id, n_entities, {r('pct_total / 100', 4)} AS share, CASE WHEN pct_total / 100 <= 0.04 THEN 'OK' ELSE 'EXCEEDS' END AS status FROM pr""",
)
def _(t: Tables):
    return rounded(profiles.size_check(nation_profiles(t), 0.04), 4)


MERGED = f"""{PR}, mg AS (SELECT feature, any_value(position) AS position, round(sum(mean * n_entities) / sum(n_entities), 6) AS mean FROM pr WHERE cluster_id IN (3, 7, 11) GROUP BY feature),
gg AS (SELECT feature, sum(mean * n_entities) / sum(n_entities) AS g FROM pr GROUP BY feature),
nw AS (SELECT 25 AS cluster_id, (SELECT count(*) FROM cf WHERE cluster_id IN (3, 7, 11)) AS n_entities, mg.feature, mg.position, mg.mean, CASE WHEN abs(g) >= 1e-12 THEN round(mg.mean / g, 4) END AS relative
  FROM mg JOIN gg ON gg.feature = mg.feature)"""


@query(
    "R08_merge_clusters",
    f"""WITH {MERGED} SELECT cluster_id, n_entities, feature, {r('mean', 3)} AS mean, {r('relative', 3)} AS relative FROM pr WHERE cluster_id NOT IN (3, 7, 11)
        UNION ALL SELECT cluster_id, n_entities, feature, {r('mean', 3)}, {r('relative', 3)} FROM nw""",
)
def _(t: Tables):
    merged = profiles.merge_clusters(nation_profiles(t), [3, 7, 11])
    return rounded(merged.select("cluster_id", "n_entities", "feature", "mean", "relative"), 3)


@query(
    "R08_merged_top_features",
    f"""WITH {MERGED}, a AS (SELECT *, row_number() OVER (ORDER BY relative DESC, position) AS hi, row_number() OVER (ORDER BY relative, position) AS lw FROM nw WHERE relative > 0)
        SELECT 'above' AS side, CAST(hi AS INT) AS rank, feature FROM a WHERE relative > 1 AND hi <= 10 UNION ALL SELECT 'below', CAST(lw AS INT), feature FROM a WHERE relative < 1 AND lw <= 10""",
)
def _(t: Tables):
    merged = profiles.merge_clusters(nation_profiles(t), [3, 7, 11]).where("cluster_id = 25")
    return profiles.merged_top_features(merged).select("side", F.col("rank").cast("int").alias("rank"), "feature")


@query(
    "R09_evidence",
    f"""WITH {TOP} SELECT cluster_id, side, CAST(rank AS INT) AS rank, feature, ratio, CASE WHEN side = 'below' THEN '' WHEN ratio >= 2 THEN '◀◀' WHEN ratio >= 1.4 THEN '◀' ELSE '' END AS flag
        FROM tp WHERE (side = 'above' AND rank <= 10) OR (side = 'below' AND rank <= 5)""",
)
def _(t: Tables):
    rows = profiles.evidence(nation_profiles(t))
    entries = []
    for side in ("above", "below"):
        e = rows.select("cluster_id", F.lit(side).alias("side"), F.explode(side).alias("e"))
        flag = F.col("e.flag") if side == "above" else F.lit("")
        entries.append(e.select("cluster_id", "side", F.col("e.rank").cast("int").alias("rank"), "e.feature", "e.ratio", flag.alias("flag")))
    return entries[0].unionByName(entries[1])


@query(
    "R10_group_by_parent",
    f"""WITH {PR}, s AS (SELECT DISTINCT pr.cluster_id, n_entities, pct_total, CASE WHEN n_regionkey = 0 THEN NULL ELSE n_regionkey END AS parent FROM pr JOIN nation ON n_nationkey = pr.cluster_id)
        SELECT parent, array_to_string(list(cluster_id ORDER BY cluster_id), ',') AS clusters, CAST(sum(n_entities) AS BIGINT) AS n_entities, {r('round(sum(pct_total), 1)', 1)} AS pct_total, count(*) AS n_clusters FROM s GROUP BY parent""",
)
def _(t: Tables):
    parents = t.nation.select(F.col("n_nationkey").alias("cluster_id"), F.when(F.col("n_regionkey") != 0, F.col("n_regionkey")).alias("parent"))
    return rounded(profiles.by_parent(nation_profiles(t), parents).withColumn("clusters", F.array_join("clusters", ",")), 1)


@query("R12_pca_projection")
def _(t: Tables):
    return rounded(profiles.pca_projection(customer_features(t), "id", NAMES), 4)


@query(
    "R14_top_mean_columns",
    f"WITH {PR} SELECT cluster_id, CAST(k AS INT) AS rank, feature FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY mean DESC, position) AS k FROM pr) WHERE k <= 3",
)
def _(t: Tables):
    return profiles.top_mean_columns(nation_profiles(t)).withColumn("rank", F.col("rank").cast("int"))


@query("R15_member_samples", "SELECT c_nationkey AS cluster_id, least(count(*), 3) AS n_samples, 6 AS n_values, TRUE AS members_only FROM customer GROUP BY c_nationkey")
def _(t: Tables):
    rows = profiles.member_samples(customer_features(t), "id", nation_profiles(t))
    owner = t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("own"))
    return rows.join(owner, "entity_id").groupBy("cluster_id").agg(
        F.count("*").alias("n_samples"), F.max(F.size("values")).alias("n_values"), F.bool_and(F.col("own") == F.col("cluster_id")).alias("members_only")
    )


ALIAS = """al AS (SELECT n_nationkey AS cluster_id, n_name AS name, 'Group ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
  CAST((row_number() OVER (ORDER BY length(CAST(n_nationkey AS VARCHAR)), CAST(n_nationkey AS VARCHAR)) - 1) % 52 + 1 AS INT), 1) AS alias FROM nation)"""


@query(
    "R16_statistical_view",
    f"""WITH {TOP}, {ALIAS} SELECT alias, n_entities, {r('pct_total', 1)} AS pct_total, {r('round(length(name) / 20.0, 3)', 3)} AS cv_f1,
        string_agg(feature, ',' ORDER BY rank) FILTER (WHERE side = 'above' AND rank <= 8) AS above, string_agg(feature, ',' ORDER BY rank) FILTER (WHERE side = 'below' AND rank <= 5) AS below
        FROM tp JOIN al ON al.cluster_id = tp.cluster_id GROUP BY alias, n_entities, pct_total, name""",
)
def _(t: Tables):
    named = t.nation.select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    f1 = t.nation.select(F.col("n_name").alias("name"), (F.length("n_name") / 20.0).alias("f1"))
    view = profiles.statistical_view(nation_profiles(t), named, f1)
    joined = {c: F.array_join(F.transform(c, lambda x: x["feature"]), ",") for c in ("above", "below")}
    return rounded(rounded(view.withColumns(joined), 1, ["pct_total"]), 3, ["cv_f1"])




@query(
    "R17_name_only_view",
    """WITH d AS (SELECT item_id AS name, replace(trim(text), chr(10), ' ') AS x FROM benchmark)
       SELECT CAST(name AS VARCHAR) AS name, CASE WHEN length(x) > 200 THEN regexp_replace(substr(x, 1, 197), ' [^ ]*$', '') || '…' ELSE x END AS description FROM d""",
)
def _(t: Tables):
    return profiles.business_view(t.benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").alias("description"), F.lit("").alias("tagline")))


@query(
    "R18_resolve_aliases",
    f"""WITH {ALIAS}, refs AS (SELECT 'Group ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(event_id % 26 + 1 AS INT), 1) AS target, event_id FROM events WHERE event_type = 'click'
          UNION ALL SELECT substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(event_id % 26 + 1 AS INT), 1), event_id FROM events WHERE event_type = 'view'
          UNION ALL SELECT 'NATION_' || CAST(event_id % 30 AS VARCHAR), event_id FROM events WHERE event_type NOT IN ('click', 'view')),
        sp AS (SELECT alias AS target, cluster_id FROM al UNION ALL SELECT substr(alias, 7), cluster_id FROM al UNION ALL SELECT name, cluster_id FROM al)
        SELECT refs.event_id, sp.cluster_id FROM refs LEFT JOIN sp ON sp.target = refs.target""",
)
def _(t: Tables):
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (F.col("event_id") % 26 + 1).cast("int"), F.lit(1))
    target = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("Group "), letter))
        .when(F.col("event_type") == "view", letter)
        .otherwise(F.concat(F.lit("NATION_"), (F.col("event_id") % 30).cast("string")))
    )
    named = t.nation.select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    return profiles.resolve_aliases(t.events.select("event_id", target.alias("target")), named).select("event_id", "cluster_id")


# -- persona gate ---------------------------------------------------------------

N1 = f"""{PE}, df AS (SELECT cluster_id, feature AS f FROM tp WHERE side = 'above' AND rank <= 3),
n1 AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, string_agg(a.f, ',' ORDER BY a.f) AS shared, count(*) AS n_shared FROM df a JOIN df b ON a.f = b.f AND a.cluster_id < b.cluster_id
  GROUP BY ALL HAVING count(*) >= 3)"""


@query("N01_shared_features", f"WITH {N1} SELECT * FROM n1")
def _(t: Tables):
    return naming.shared_features(personas(t)).withColumn("shared", F.array_join("shared", ","))


STOPS = ["of", "in", "by", "then", "and", "the"]
N2 = """tok AS (SELECT cluster_id, unnest(list_filter(regexp_extract_all(lower(description), '[\\p{L}\\p{N}_]{2,}'), lambda w: w NOT IN ('of', 'in', 'by', 'then', 'and', 'the'))) AS w FROM pe),
tf AS (SELECT cluster_id, w, count(*) AS tf FROM tok GROUP BY ALL), dfq AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
we AS (SELECT cluster_id, tf.w, tf * (ln((1 + (SELECT count(*) FROM pe)) / (1.0 + df)) + 1) AS x FROM tf JOIN dfq ON dfq.w = tf.w),
nm AS (SELECT cluster_id, sqrt(sum(x * x)) AS n FROM we GROUP BY cluster_id),
n2 AS (SELECT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b, sum(a.x / na.n * b.x / nb.n) AS cosine FROM we a JOIN we b ON a.w = b.w AND a.cluster_id < b.cluster_id
  JOIN nm na ON na.cluster_id = a.cluster_id JOIN nm nb ON nb.cluster_id = b.cluster_id GROUP BY ALL)"""


@query("N02_similar_descriptions", f"WITH {PE}, {N2} SELECT cluster_a, cluster_b, {r('round(cosine, 3)', 3)} AS cosine FROM n2 WHERE cosine > 0.5")
def _(t: Tables):
    return rounded(naming.similar_descriptions(personas(t), 0.5, STOPS), 3)


@query(
    "N03_gate_issues",
    f"""WITH {N1}, {N2}
      SELECT 'low_confidence' AS kind, printf('%.1f', avg(confidence) - 3) AS subject FROM pe HAVING avg(confidence) - 3 < 6
      UNION ALL SELECT 'duplicate_name', region FROM pe GROUP BY region HAVING count(*) > 1
      UNION ALL SELECT 'shared_features', CAST(cluster_a AS VARCHAR) || ' & ' || CAST(cluster_b AS VARCHAR) FROM n1
      UNION ALL SELECT 'similar_description', CAST(cluster_a AS VARCHAR) || ' & ' || CAST(cluster_b AS VARCHAR) FROM n2 WHERE cosine > 0.85
      UNION ALL SELECT 'missing_must_have', 'night owls' FROM pe HAVING count(*) FILTER (WHERE contains(lower(description), 'night owls') OR contains(lower(description), 'night-owls')) = 0
      UNION ALL SELECT 'missing_must_have', 'n_urgent' FROM pe HAVING count(*) FILTER (WHERE contains(lower(description), 'n_urgent')) = 0""",
)
def _(t: Tables):
    named = personas(t).withColumns({"name": F.element_at("traits", 1), "confidence": F.col("confidence") - 3})
    return naming.gate_issues(named, ["Night Owls", "n_urgent"], STOPS)


@query(
    "N04_parse_personas",
    """SELECT CAST(user_id AS VARCHAR) AS cluster_id, event_type AS name, CAST(NULL AS VARCHAR) AS tagline, value AS confidence FROM events WHERE event_type <> 'error'""",
)
def _(t: Tables):
    good = F.concat(F.lit('{"'), F.col("user_id").cast("string"), F.lit('": {"name": "'), F.col("event_type"), F.lit('", "confidence": '), F.col("value").cast("string"), F.lit("}}"))
    replies = t.events.select(F.when(F.col("event_type") == "error", F.lit("no json here")).otherwise(good).alias("json"))
    return naming.parse_personas(replies).select("cluster_id", "name", "tagline", "confidence")


@query(
    "N05_default_personas",
    f"WITH {TOP} SELECT cluster_id, 'Cluster ' || CAST(cluster_id AS VARCHAR) AS name, string_agg(feature, ',' ORDER BY rank) AS dominant FROM tp WHERE side = 'above' AND rank <= 3 GROUP BY cluster_id",
)
def _(t: Tables):
    return naming.default_personas(nation_profiles(t)).select("cluster_id", "name", F.array_join("dominant_features", ",").alias("dominant"))


# -- classifier check -------------------------------------------------------------


@query("V01_attach_personas", "SELECT n_name AS label, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER () AS share FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2 GROUP BY n_name".replace("count(*) * 1.0 / sum(count(*)) OVER ()", r("count(*) * 1.0 / sum(count(*)) OVER ()")))
def _(t: Tables):
    named = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    placed = validation.attach_personas(t.customer, named, "c_nationkey")
    return rounded(validation.class_distribution(placed, "persona"))


@query("V01_unmapped_rows", "SELECT count(*) AS n_unmapped FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2")
def _(t: Tables):
    named = t.nation.where("n_regionkey <> 2").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    return validation.unmapped_rows(t.customer, named, "c_nationkey")


def _value_bands(t: Tables) -> DataFrame:
    """Customers in three bands of spend: a label the features can predict."""
    f = customer_features(t)
    return f.withColumn("band", F.when(F.col("total") < 1_500_000, "low").when(F.col("total") < 3_500_000, "mid").otherwise("top"))


for _model in ("random_forest", "xgboost", "logistic_regression", "naive_bayes", "svm", "knn"):

    def _fit(t: Tables, model=_model):
        predictions, _classes = validation.cross_validate(_value_bands(t), "id", "band", NAMES, model, folds=5)
        return rounded(validation.overall_scores(validation.confusion(predictions)), 4)

    query(f"V02_model_{_model}")(_fit)


@query(
    "V04_stratified_folds",
    """WITH c AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS fold)
       SELECT label, fold, CAST(ceil((n - fold) / 5.0) AS BIGINT) AS n FROM c, f""",
)
def _(t: Tables):
    return validation.stratified_folds(t.customer, "c_custkey", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("label"), "fold").agg(F.count("*").alias("n"))


@query("V05_out_of_fold", "SELECT c_custkey AS id, TRUE AS predicted FROM customer")
def _(t: Tables):
    predictions, _classes = validation.cross_validate(_value_bands(t), "id", "band", NAMES, "naive_bayes")
    return predictions.select("id", F.col("pred").isNotNull().alias("predicted"))


PRED = """p AS (SELECT l_returnflag AS y, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS pred FROM lineitem),
cl AS (SELECT y AS label, count(*) AS support, count(*) FILTER (WHERE y = pred) AS hits, (SELECT count(*) FROM p q WHERE q.pred = p.y) AS predicted FROM p GROUP BY y),
f AS (SELECT *, 2.0 * hits / (support + predicted) AS f1 FROM cl)"""


def _guessed(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return validation.confusion(t.lineitem.select(F.col("l_returnflag").alias("y"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("pred")))


@query("V06_class_scores", f"WITH {PRED} SELECT label, support, hits, predicted, {r('f1', 4)} AS f1 FROM f")
def _(t: Tables):
    return rounded(validation.class_scores(_guessed(t)), 4)


@query(
    "V06_overall_scores",
    f"WITH {PRED} SELECT {r('sum(hits) * 1.0 / sum(support)')} AS accuracy, {r('avg(f1)')} AS f1_macro, {r('sum(f1 * support) / sum(support)')} AS f1_weighted FROM f",
)
def _(t: Tables):
    return rounded(validation.overall_scores(_guessed(t)).drop("kappa"))


@query(
    "V07_kappa",
    f"""WITH {PRED}, k AS (SELECT sum(hits) * 1.0 / sum(support) AS po, sum(support * 1.0 * predicted) / (sum(support) * 1.0 * sum(support)) AS pe FROM f)
        SELECT {r('(po - pe) / (1 - pe)')} AS kappa FROM k""",
)
def _(t: Tables):
    return rounded(validation.overall_scores(_guessed(t)).select("kappa"))


@query("V08_importances")
def _(t: Tables):
    return validation.feature_importances(_value_bands(t), "id", "band", NAMES)


@query(
    "V09_f1_gate",
    f"""WITH {PRED} SELECT {r('avg(f1)', 4)} AS f1_macro, CASE WHEN avg(f1) >= 0.7 THEN 'proceed' ELSE 'recluster' END AS action,
        (SELECT string_agg(label, ',' ORDER BY f1, label) FROM (SELECT * FROM f ORDER BY f1, label LIMIT 3)) AS hardest FROM f""",
)
def _(t: Tables):
    cells = _guessed(t)
    gate = validation.f1_gate(validation.overall_scores(cells), validation.class_scores(cells))
    return rounded(gate.withColumn("hardest", F.array_join("hardest", ",")), 4)


