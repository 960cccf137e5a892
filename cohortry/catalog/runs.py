"""Run histories, run comparison, case memory, feedback, the event log, and the whole job.

Histories and logs are derived from orders, parts and events, so that they grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.catalog.features import ROLES
from cohortry.catalog.profiling import scratch
from cohortry.functions.columns import month_index
from cohortry.functions.moments import column_moments
from cohortry.operators import feedback, profiles, runs
from cohortry.operators.cleaning import scaled_columns
from cohortry.operators.clustering import kmeans
from cohortry.plans.feature_plan import build_features
from cohortry.plans.segmentation import Settings, segment_documents, segment_events
from cohortry.session import cut_lineage
from cohortry.streaming import eventlog

# -- iterations: a run per order priority, an iteration per month ----------------------

HIST = """m AS (SELECT o_orderpriority AS run_id, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 23941 AS INT) AS iteration, avg(o_totalprice) AS a, count(*) AS n,
   sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) / count(*) AS f, max(o_orderkey) AS k FROM orders GROUP BY ALL)"""


def monthly(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("run_id"), (month_index(F.col("o_orderdate")) - 23941).cast("int").alias("iteration")).agg(
        F.avg("o_totalprice").alias("a"), F.count("*").alias("n"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("f"), F.max("o_orderkey").alias("k")
    )


@query(
    "B01_iteration_table",
    f"""WITH {HIST}, s AS (SELECT run_id, iteration, a / 10000 AS score FROM m)
        SELECT run_id, iteration, {r('score', 4)} AS score, coalesce(score > max(score) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS became_best FROM s""",
)
def _(t: Tables):
    return rounded(runs.became_best(monthly(t).select("run_id", "iteration", (F.col("a") / 10_000).alias("score"))), 4)


@query(
    "B02_target_schedule",
    f"""WITH RECURSIVE {HIST}, h AS (SELECT run_id, iteration, f * 1.2 AS silhouette, k % 5 = 0 AS stopped, row_number() OVER (PARTITION BY run_id ORDER BY iteration) AS p FROM m),
    st AS (
      SELECT run_id, CAST(0 AS BIGINT) AS p, CAST(0 AS INT) AS iteration, CAST(0.5 AS DOUBLE) AS target, CAST(0.5 AS DOUBLE) AS nxt, 0 AS relax, 0 AS rebuild, FALSE AS missed, FALSE AS relaxed, FALSE AS rebuilt
      FROM (SELECT DISTINCT run_id FROM h)
      UNION ALL
      SELECT q.run_id, q.p, q.iteration, q.target,
        CASE WHEN q.missed AND q.relax + 1 >= 3 THEN CAST(round(greatest(0.05, q.target - 0.1), 3) AS DOUBLE) ELSE q.target END,
        CASE WHEN q.stopped THEN q.relax WHEN NOT q.missed THEN 0 WHEN q.relax + 1 >= 3 THEN 0 ELSE q.relax + 1 END,
        CASE WHEN q.stopped THEN q.rebuild WHEN NOT q.missed THEN 0 WHEN q.rebuild + 1 >= 3 THEN 0 ELSE q.rebuild + 1 END,
        q.missed, q.missed AND q.relax + 1 >= 3, q.missed AND q.rebuild + 1 >= 3
      FROM (SELECT h.run_id, h.p, h.iteration, st.nxt AS target, st.relax, st.rebuild, h.stopped, NOT h.stopped AND h.silhouette < st.nxt AS missed
            FROM st JOIN h ON h.run_id = st.run_id AND h.p = st.p + 1) q)
    SELECT run_id, iteration, {r('target', 3)} AS target, missed, relaxed, rebuilt FROM st WHERE p > 0""",
)
def _(t: Tables):
    history = monthly(t).select("run_id", "iteration", (F.col("f") * 1.2).alias("silhouette"), (F.col("k") % 5 == 0).alias("stopped"))
    return rounded(runs.target_schedule(history), 3)


@query("flagship_customer_segments")
def _(t: Tables):
    """Which customers behave alike, and what marks each group?"""
    plan = [
        {"builder": "group_aggregate", "params": {"windows": [12, "all"], "metrics": ["count", "sum"]}},
        {"builder": "overall_aggregate", "params": {"windows": [12, "all"]}},
        {"builder": "frequency_recency", "params": {"windows": [12, "all"]}},
    ]
    features = cut_lineage(build_features(t.orders, ROLES, plan))
    names = [c for c in features.columns if c != "o_custkey"]
    moments = column_moments(features, names)
    scaled = F.array(*scaled_columns({c: moments[c] for c in names if not moments[c].constant}))
    labels = kmeans(features.select(F.col("o_custkey").alias("id"), scaled.alias("features")), 4)
    placed = features.withColumn("id", F.col("o_custkey")).join(labels, "id")
    tops = profiles.top_features(profiles.cluster_profiles(placed, names))
    return rounded(tops.select("cluster_id", "n_entities", "pct_total", "side", "rank", "feature", "mean", "ratio"), 4)


@query("B03_segmentation_job")
def _(t: Tables):
    done = segment_events(t.orders, ROLES, Settings())
    sizes = done.best.labels.groupBy("cluster_id").agg(F.count("*").alias("n_entities"))
    named = done.best.personas.select("cluster_id", "name", F.array_join("dominant_features", ",").alias("dominant"))
    return sizes.join(named, "cluster_id").withColumn("status", F.lit(done.status))


@query("B03_text_segmentation_job")
def _(t: Tables):
    done = segment_documents(t.documents, "doc_id", ["text"])
    sizes = done.best.labels.groupBy("cluster_id").agg(F.count("*").alias("n_entities"))
    named = done.best.personas.select("cluster_id", "name", F.array_join("dominant_features", ",").alias("dominant"))
    return sizes.join(named, "cluster_id").withColumn("status", F.lit(done.status))


# -- run against run --------------------------------------------------------------------


@query(
    "B06_compare_runs",
    f"""WITH a AS (SELECT c_custkey AS id, c_nationkey AS k FROM customer), b AS (SELECT c_custkey AS id, n_regionkey * 4 AS k FROM customer JOIN nation ON n_nationkey = c_nationkey),
    c AS (SELECT a.k AS x, b.k AS y, count(*) AS n FROM a JOIN b ON a.id = b.id GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS t FROM c),
    sa AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY x)), sb AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY y)),
    pa AS (SELECT k, count(*) * 1.0 / sum(count(*)) OVER () AS share, any_value(n_name) AS name FROM a JOIN nation ON n_nationkey = k GROUP BY k),
    pb AS (SELECT b.k, count(*) * 1.0 / sum(count(*)) OVER () AS share, any_value(n_name) AS name FROM b JOIN nation ON n_nationkey = b.k GROUP BY b.k)
    SELECT {r('(s.s - sa.s * sb.s / (s.t * (s.t - 1) / 2.0)) / ((sa.s + sb.s) / 2.0 - sa.s * sb.s / (s.t * (s.t - 1) / 2.0))')} AS ari,
      {r('(SELECT count(*) FROM pa JOIN pb ON pa.name = pb.name) * 1.0 / (SELECT count(*) FROM (SELECT name FROM pa UNION SELECT name FROM pb))')} AS name_jaccard,
      {r('(SELECT sum(abs(coalesce(pa.share, 0) - coalesce(pb.share, 0))) FROM pa FULL JOIN pb ON pa.k = pb.k)')} AS size_l1,
      (SELECT count(*) FROM pa) AS n_personas_prev, (SELECT count(*) FROM pb) AS n_personas_curr, {r('0.7 - 0.65')} AS f1_delta FROM s, sa, sb""",
)
def _(t: Tables):
    nations = t.nation.select("n_nationkey", "n_regionkey", "n_name")
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster_id"))
    b = t.customer.join(nations, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("id"), (F.col("n_regionkey") * 4).alias("cluster_id"))
    total = t.customer.count()

    def shares(x: DataFrame) -> DataFrame:
        sizes = x.groupBy("cluster_id").agg((F.count("*") / F.lit(total)).alias("share"))
        return sizes.join(nations, F.col("n_nationkey") == F.col("cluster_id")).select("cluster_id", F.col("n_name").alias("name"), "share")

    return rounded(runs.compare_runs(a, b, shares(a), shares(b), 0.65, 0.7))


STREAK = f"""{HIST}, q AS (SELECT run_id, iteration AS run, CASE WHEN n % 7 = 0 THEN NULL ELSE 0.8 + f / 3 END AS ari FROM m),
w AS (SELECT *, coalesce(ari >= 0.9, FALSE) AS ok, sum(CASE WHEN coalesce(ari >= 0.9, FALSE) THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS g FROM q),
z AS (SELECT run_id, run, ari, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g ORDER BY run ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM w)"""


@query("B07_convergence", f"WITH {STREAK} SELECT run_id, run, streak, streak >= 3 AS converged FROM z")
def _(t: Tables):
    table = monthly(t).select("run_id", F.col("iteration").alias("run"), F.when(F.col("n") % 7 == 0, None).otherwise(0.8 + F.col("f") / 3).alias("ari"))
    return runs.convergence(table, by=["run_id"]).select("run_id", "run", "streak", "converged")


@query(
    "B08_timeline",
    f"""WITH a AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS run, avg(p_size) / 50 AS cv_f1_macro, count(*) AS n_clusters FROM part GROUP BY 1),
        d AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS run, avg(p_retailprice) / 2000 AS ari FROM part GROUP BY 1),
        v AS (SELECT CAST(replace(p_brand, 'Brand#', '') AS INT) AS run, count(*) AS n_critiques, count(*) FILTER (WHERE p_size % 2 = 0) AS n_accepted, count(*) FILTER (WHERE p_size % 2 = 1) AS n_rejected FROM part WHERE p_type = 'ECONOMY' GROUP BY 1)
        SELECT a.run, {r('cv_f1_macro', 4)} AS cv_f1_macro, n_clusters, {r('ari', 4)} AS ari, coalesce(n_critiques, 0) AS n_critiques, coalesce(n_accepted, 0) AS n_accepted, coalesce(n_rejected, 0) AS n_rejected,
               {r('n_accepted * 1.0 / n_critiques', 4)} AS accept_rate FROM a LEFT JOIN d ON d.run = a.run LEFT JOIN v ON v.run = a.run""",
)
def _(t: Tables):
    run = F.regexp_replace("p_brand", "Brand#", "").cast("int").alias("run")
    measured = t.part.groupBy(run).agg((F.avg("p_size") / 50).alias("cv_f1_macro"), F.count("*").alias("n_clusters"))
    diffs = t.part.groupBy(run).agg((F.avg("p_retailprice") / 2000).alias("ari"))
    even = F.col("p_size") % 2
    reviews = t.part.where("p_type = 'ECONOMY'").groupBy(run).agg(
        F.count("*").alias("n_critiques"), F.count(F.when(even == 0, 1)).alias("n_accepted"), F.count(F.when(even == 1, 1)).alias("n_rejected")
    )
    return rounded(runs.timeline(measured, diffs, reviews), 4)


# -- case memory: a case per supplier, its columns the brands it ships -----------

BRANDS = [f"brand {i}" for i in range(1, 16)]
CASES = """cs AS (SELECT l_suppkey AS seq, list(DISTINCT lower(replace(p_brand, '#', ''))) AS cols, count(*) AS n_rows FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_suppkey),
cur AS (SELECT [replace(x, ' ', '') for x in list_transform(range(1, 16), lambda i: 'brand ' || CAST(i AS VARCHAR))] AS c),
mt AS (SELECT seq, n_rows, len(list_intersect(cols, c)) * 1.0 / len(list_distinct(list_concat(cols, c))) AS j, abs(110 - n_rows) * 1.0 / n_rows AS d FROM cs, cur)"""


def supplier_cases(t: Tables) -> DataFrame:
    shipped = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    per = shipped.groupBy(F.col("l_suppkey").alias("seq")).agg(F.collect_set("p_brand").alias("columns"), F.count("*").alias("n_rows"))
    return per.select("seq", F.concat(F.lit("case-"), F.col("seq").cast("string")).alias("case_id"), "columns", "n_rows", F.lit("").alias("purpose"))


@query(
    "A01_match_cases",
    f"""WITH {CASES} SELECT seq, {r('j')} AS column_jaccard, {r('d')} AS row_delta, CASE WHEN j >= 0.9 AND d <= 0.1 THEN 'exact' WHEN j >= 0.4 THEN 'similar' END AS "match" FROM mt""",
)
def _(t: Tables):
    return rounded(runs.match_cases(supplier_cases(t), BRANDS, 110, "").select("seq", "column_jaccard", "row_delta", "match"))


@query(
    "A01_find_case",
    f"""WITH {CASES}, k AS (SELECT seq, j, CASE WHEN j >= 0.9 AND d <= 0.1 THEN 'exact' WHEN j >= 0.4 THEN 'similar' END AS "match" FROM mt)
        SELECT seq, "match" FROM k WHERE "match" IS NOT NULL ORDER BY "match" = 'exact' DESC, j DESC, seq LIMIT 1""",
)
def _(t: Tables):
    return runs.find_case(supplier_cases(t), BRANDS, 110, "").select("seq", "match")


@query("A01_purpose_ratio")
def _(t: Tables):
    ratio = runs.text_ratio(F.lit("Nation one"), F.col("n_name"))
    return rounded(t.nation.join(t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).count(), "n_nationkey").select("n_name", ratio.alias("ratio")), 4)


@query(
    "A02_save_case",
    """WITH cs AS (SELECT l_suppkey AS seq, 'case-' || CAST(l_suppkey AS VARCHAR) AS case_id, list_sort(list(DISTINCT p_brand)) AS cols, count(*) AS n_rows FROM lineitem JOIN part ON p_partkey = l_partkey
         GROUP BY l_suppkey),
       nw AS (SELECT * FROM cs WHERE seq = (SELECT max(seq) FROM cs)),
       hit AS (SELECT min(cs.seq) AS seq FROM cs, nw WHERE len(list_intersect(cs.cols, nw.cols)) * 1.0 / len(list_distinct(list_concat(cs.cols, nw.cols))) >= 0.9
                AND abs(nw.n_rows - cs.n_rows) * 1.0 / greatest(cs.n_rows, 1) <= 0.1)
       SELECT seq, case_id, n_rows FROM cs WHERE seq <> (SELECT seq FROM hit) UNION ALL SELECT (SELECT seq FROM hit), 'newest', n_rows FROM nw""",
)
def _(t: Tables):
    cases = supplier_cases(t)
    newest = cases.orderBy(F.desc("seq")).limit(1).withColumn("case_id", F.lit("newest"))
    return runs.save_case(cases, newest).select("seq", "case_id", "n_rows")


@query(
    "A03_lessons",
    f"""WITH {HIST}, h AS (SELECT run_id, iteration, a AS score, CASE WHEN n % 2 = 0 THEN 'kmeans' ELSE 'hierarchical' END AS algorithm, CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS n_merges,
          n % 13 = 0 AS relaxed, CASE WHEN n % 5 = 0 THEN CAST(n AS DOUBLE) END AS vif_threshold FROM m),
        c AS (SELECT o_orderpriority AS run_id, o_orderstatus AS label, avg(o_totalprice) AS f1 FROM orders GROUP BY ALL),
        t AS (SELECT run_id, arg_max(algorithm, (score, -iteration)) AS winner, coalesce(string_agg(CAST(iteration AS VARCHAR), ',' ORDER BY iteration) FILTER (WHERE n_merges > 0), '') AS merge_iterations,
           count(*) FILTER (WHERE relaxed) AS n_relaxed, {r('arg_max(vif_threshold, iteration) FILTER (WHERE vif_threshold IS NOT NULL)', 2)} AS last_vif FROM h GROUP BY run_id)
        SELECT t.*, (SELECT string_agg(label, ',' ORDER BY f1, label) FROM c WHERE c.run_id = t.run_id) AS hardest FROM t""",
)
def _(t: Tables):
    n = F.col("n")
    history = monthly(t).select(
        "run_id", "iteration", F.col("a").alias("score"), F.when(n % 2 == 0, "kmeans").otherwise("hierarchical").alias("algorithm"),
        F.when(n % 11 == 0, 1).otherwise(0).alias("n_merges"), (n % 13 == 0).alias("relaxed"), F.when(n % 5 == 0, n.cast("double")).alias("vif_threshold"),
    )
    class_f1 = t.orders.groupBy(F.col("o_orderpriority").alias("run_id"), F.col("o_orderstatus").alias("label")).agg(F.avg("o_totalprice").alias("f1"))
    out = runs.lessons(history, class_f1)
    flat = out.withColumns({"merge_iterations": F.array_join(F.transform("merge_iterations", lambda i: i.cast("string")), ","), "hardest": F.array_join("hardest", ",")})
    return rounded(flat, 2)


# -- feedback: an entry per event, its type and priority from the event -------------------

FB = """fb AS (SELECT 'fb_' || CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS date,
   CASE event_type WHEN 'signup' THEN 'naming_hint' WHEN 'error' THEN 'manual_override' WHEN 'purchase' THEN 'merge' ELSE 'global_rule' END AS type,
   CASE WHEN CAST(props ->> '$.k' AS INT) < 20 THEN 'high' WHEN CAST(props ->> '$.k' AS INT) < 60 THEN NULL ELSE 'low' END AS pr, CASE WHEN value > 12 THEN FALSE END AS act,
   user_id, event_id, value, props, ts FROM events),
lg AS (SELECT *, coalesce(pr, 'medium') AS priority, coalesce(act, TRUE) AS active FROM fb)"""


def entries(t: Tables) -> DataFrame:
    k, event = F.from_json("props", "k INT")["k"], F.col("event_type")
    text = F.concat(F.lit("Rule "), F.col("user_id").cast("string"), F.lit(" says "), F.col("event_type"))
    return t.events.select(
        F.concat(F.lit("fb_"), F.col("event_id").cast("string")).alias("id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date"),
        F.when(event == "signup", "naming_hint").when(event == "error", "manual_override").when(event == "purchase", "merge").otherwise("global_rule").alias("type"),
        F.when(k < 20, "high").when(k < 60, None).otherwise("low").alias("priority"),
        F.when(F.col("value") > 12, F.lit(False)).alias("active"),
        text.alias("rule"),
        text.alias("hint"),
        F.col("user_id").cast("string").alias("target_cluster_id"),
        F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("NATION_"), (F.col("user_id") % 40).cast("string"))).alias("target_cluster_name"),
        F.create_map(F.lit("name"), F.lit("old"), F.lit("k"), k.cast("string")).alias("before"),
        F.create_map(F.lit("name"), event, F.lit("k"), k.cast("string")).alias("after"),
        F.array(F.col("user_id").cast("string"), k.cast("string")).alias("merged_ids"),
        F.col("event_id"),
        F.col("user_id"),
    )


@query("H01_append", f"WITH {FB} SELECT id, date, type, priority, active FROM lg")
def _(t: Tables):
    rows = entries(t)
    log = feedback.append(None, rows.where("type = 'merge'"))
    return feedback.append(log, rows.where("type <> 'merge'")).select("id", "date", "type", "priority", "active")


CHANGES = """ch AS (SELECT 'fb_' || CAST(event_id // 3 AS VARCHAR) AS id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'delete' WHEN 1 THEN 'active' ELSE 'priority' END AS field,
   CASE event_id % 4 WHEN 1 THEN CASE WHEN value > 5 THEN 'true' ELSE 'false' END ELSE CASE WHEN value > 5 THEN 'high' ELSE 'low' END END AS v FROM events)"""


def changes(t: Tables) -> DataFrame:
    e, big = F.col("event_id"), F.col("value") > 5
    field = F.when(e % 4 == 0, "delete").when(e % 4 == 1, "active").otherwise("priority")
    value = F.when(e % 4 == 1, F.when(big, "true").otherwise("false")).otherwise(F.when(big, "high").otherwise("low"))
    return t.events.select(F.concat(F.lit("fb_"), F.floor(e / 3).cast("string")).alias("id"), e.alias("seq"), field.alias("field"), value.alias("value"))


@query(
    "H02_fold_changes",
    f"""WITH {FB}, {CHANGES}, l AS (SELECT id, arg_max(v, seq) FILTER (WHERE field = 'priority') AS p, arg_max(v, seq) FILTER (WHERE field = 'active') AS a, bool_or(field = 'delete') AS d FROM ch GROUP BY id)
        SELECT lg.id, coalesce(l.p, priority) AS priority, coalesce(CAST(l.a AS BOOLEAN), active) AS active FROM lg LEFT JOIN l ON l.id = lg.id WHERE NOT coalesce(l.d, FALSE)""",
)
def _(t: Tables):
    return feedback.fold_changes(feedback.append(None, entries(t)), changes(t)).select("id", "priority", "active")


RULES = f"""{FB}, ru AS (SELECT *, row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'low' THEN 2 ELSE 1 END, date_trunc('second', ts) DESC, id) AS place FROM lg WHERE active)"""


@query("H03_active_rules", f"WITH {RULES} SELECT id, type, priority, CAST(place AS INT) AS place FROM ru WHERE place <= 25")
def _(t: Tables):
    return feedback.active_rules(feedback.append(None, entries(t))).select("id", "type", "priority", F.col("place").cast("int").alias("place"))


@query(
    "H03_preference_lines",
    f"""WITH {RULES}, x AS (SELECT ru.*, event_type FROM ru JOIN events e ON e.event_id = ru.event_id WHERE place <= 25),
        h AS (SELECT *, CASE WHEN user_id % 3 = 0 THEN 'NATION_' || CAST(user_id % 40 AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS target FROM x)
        SELECT CAST(place AS INT) AS place, 0 AS part, priority, substr(date, 1, 10) AS "day", type, target, CASE WHEN type = 'manual_override' THEN 'name' END AS "key",
          CASE WHEN type = 'manual_override' THEN 'old' END AS "before",
          CASE type WHEN 'manual_override' THEN event_type WHEN 'merge' THEN target ELSE 'Rule ' || CAST(user_id AS VARCHAR) || ' says ' || event_type END AS "after" FROM h""",
)
def _(t: Tables):
    rules = feedback.active_rules(feedback.append(None, entries(t)))
    return feedback.preference_rows(rules).withColumns({"place": F.col("place").cast("int"), "part": F.col("part").cast("int")}).drop("merged_ids")


@query(
    "H04_rules_hash",
    f"""WITH {RULES}, x AS (SELECT ru.*, event_type FROM ru JOIN events e ON e.event_id = ru.event_id WHERE place <= 25),
        h AS (SELECT place, id || chr(1) || 'Rule ' || CAST(user_id AS VARCHAR) || ' says ' || event_type || chr(1) || CAST(user_id AS VARCHAR) || chr(1)
                || CASE WHEN user_id % 3 = 0 THEN 'NATION_' || CAST(user_id % 40 AS VARCHAR) ELSE '' END AS s FROM x)
        SELECT substr(sha256(string_agg(s, chr(2) ORDER BY place)), 1, 16) AS entries_hash, count(*) AS n_input FROM h""",
)
def _(t: Tables):
    return feedback.rules_hash(feedback.active_rules(feedback.append(None, entries(t))))


@query(
    "H04_drop_stale",
    f"""WITH {FB} SELECT id FROM lg WHERE user_id % 3 <> 0 OR user_id % 40 IN (SELECT n_nationkey FROM nation)""",
)
def _(t: Tables):
    known = t.nation.select(F.concat(F.lit("NATION_"), F.col("n_nationkey").cast("string")).alias("name"))
    return feedback.drop_stale(feedback.append(None, entries(t)), known).select("id")


@query(
    "H04_apply_decisions",
    f"""WITH {FB} SELECT count(*) FILTER (WHERE type = 'global_rule') AS n_rules, count(*) FILTER (WHERE type = 'global_rule') AS n_kept, count(*) FILTER (WHERE type = 'merge') AS n_merged,
        count(*) FILTER (WHERE type NOT IN ('global_rule', 'merge')) AS n_dropped FROM lg""",
)
def _(t: Tables):
    log = feedback.append(None, entries(t))
    action = F.when(F.col("type") == "global_rule", "keep").when(F.col("type") == "merge", "merge_into").otherwise("drop")
    kept, ledger = feedback.apply_decisions(log, log.select("id", action.alias("action")))
    return kept.agg(F.count("*").alias("n_rules"), F.lit(1).alias("_k")).join(ledger.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(
    "H04_near_duplicates",
    f"""WITH worded AS (SELECT doc_id AS id, trim(text) AS text FROM documents WHERE trim(coalesce(text, '')) <> ''),
        firsts AS (SELECT text, min(id) AS a FROM worded GROUP BY text),
        tok AS (SELECT a AS id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ('the', 'and', 'of'))) AS w FROM firsts),
        tf AS (SELECT id, w, count(*) AS tf FROM tok GROUP BY ALL), dfq AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
        we AS (SELECT id, tf.w, tf * (ln((1 + (SELECT count(*) FROM firsts)) / (1.0 + df)) + 1) AS x FROM tf JOIN dfq ON dfq.w = tf.w),
        nm AS (SELECT id, sqrt(sum(x * x)) AS n FROM we GROUP BY id),
        near AS (SELECT x.id AS a, y.id AS b, sum(x.x / nx.n * y.x / ny.n) AS cosine FROM we x JOIN we y ON x.w = y.w AND x.id < y.id
          JOIN nm nx ON nx.id = x.id JOIN nm ny ON ny.id = y.id GROUP BY ALL)
        SELECT a, b, {r("cosine", 4)} AS cosine FROM near WHERE cosine > 0.85
        UNION ALL SELECT a, id, {r("1.0", 4)} FROM worded JOIN firsts USING (text) WHERE id > a""",
)
def _(t: Tables):
    rules = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("rule"), F.lit(None).cast("string").alias("hint"))
    return rounded(feedback.near_duplicates(rules, 0.85, ["the", "and", "of"]), 4)


VERDICTS = "vd AS (SELECT 'fb_' || CAST(event_id AS VARCHAR) AS id, CASE event_id % 5 WHEN 0 THEN 'useful' WHEN 1 THEN 'noise' WHEN 2 THEN 'neutral' ELSE 'unclear' END AS verdict FROM events)"


def verdicts(t: Tables) -> DataFrame:
    e = F.col("event_id") % 5
    word = F.when(e == 0, "useful").when(e == 1, "noise").when(e == 2, "neutral").otherwise("unclear")
    return t.events.select(F.concat(F.lit("fb_"), F.col("event_id").cast("string")).alias("id"), word.alias("verdict"))


@query(
    "H05_apply_verdicts",
    f"""WITH {FB}, {VERDICTS} SELECT lg.id, CASE WHEN verdict = 'useful' THEN 'high' ELSE priority END AS priority, CASE WHEN verdict = 'noise' THEN FALSE ELSE active END AS active
        FROM lg LEFT JOIN vd ON vd.id = lg.id""",
)
def _(t: Tables):
    return feedback.apply_verdicts(feedback.append(None, entries(t)), verdicts(t)).select("id", "priority", "active")


@query(
    "H05_verdict_counts",
    f"""WITH {VERDICTS} SELECT count(*) FILTER (WHERE verdict = 'useful') AS useful, count(*) FILTER (WHERE verdict = 'neutral') AS neutral, count(*) FILTER (WHERE verdict = 'noise') AS noise,
        count(*) FILTER (WHERE verdict IN ('useful', 'neutral', 'noise')) AS reviewed FROM vd""",
)
def _(t: Tables):
    return feedback.verdict_counts(verdicts(t))


@query(
    "H07_acceptance_rate",
    f"SELECT quality, count(*) AS n_critiques, count(*) FILTER (WHERE toxic = 0) AS n_accepted, {r('avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END)', 4)} AS accept_rate FROM labels GROUP BY quality",
)
def _(t: Tables):
    return rounded(feedback.acceptance_rate(t.labels.select("quality", (F.col("toxic") == 0).alias("accepted")), ["quality"]), 4)


# -- event log: users are runs, event types are log events --------------------------------

LOG = """lo AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'run_started' WHEN 'error' THEN 'iteration_started' WHEN 'purchase' THEN 'pipeline_complete' ELSE 'agent_report' END AS event,
  date_trunc('second', ts) AS ts, CAST(user_id AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'Clusterer' WHEN 'view' THEN 'Classifier' END AS agent, CAST(props ->> '$.k' AS INT) AS iteration,
  CASE WHEN value > 15 THEN 'blocked' WHEN value > 8 THEN 'warning' ELSE 'success' END AS status, CASE WHEN value > 15 THEN ['cost ' || CAST(CAST(props ->> '$.k' AS INT) AS VARCHAR), 'late'] ELSE [] END AS issues,
  CASE WHEN value > 18 THEN 'escalate' ELSE 'retry' END AS recommendation FROM events)"""


def log(t: Tables) -> DataFrame:
    k, v, event = F.from_json("props", "k INT")["k"], F.col("value"), F.col("event_type")
    return t.events.select(
        F.col("event_id").alias("seq"),
        F.when(event == "signup", "run_started").when(event == "error", "iteration_started").when(event == "purchase", "pipeline_complete").otherwise("agent_report").alias("event"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").cast("string").alias("run_id"),
        F.when(event == "click", "Clusterer").when(event == "view", "Classifier").alias("agent"),
        k.alias("iteration"),
        F.when(v > 15, "blocked").when(v > 8, "warning").otherwise("success").alias("status"),
        F.when(v > 15, F.array(F.concat(F.lit("cost "), k.cast("string")), F.lit("late"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.lit(None).cast("string").alias("metrics"),
        F.when(v > 18, "escalate").otherwise("retry").alias("recommendation"),
    )


def logged(t: Tables, bad_lines: bool = False) -> str:
    """Write the log as JSON files (two batches), optionally with lines that are not JSON."""
    path = scratch(t, "events") + "/log"
    rows = log(t)
    eventlog.append_events(rows.where("event = 'agent_report'"), path)
    eventlog.append_events(rows.where("event <> 'agent_report'"), path)
    if bad_lines:
        t.events.select(F.concat(F.lit("{broken "), F.col("props")).alias("value")).write.mode("append").text(path)
    return path


@query("E01_append_events", f"WITH {LOG} SELECT event, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM lo GROUP BY event")
def _(t: Tables):
    back = eventlog.read_events(t.spark, logged(t))
    return back.groupBy("event").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("E02_read_events", f"WITH {LOG} SELECT seq, event, run_id, agent, iteration, status FROM lo")
def _(t: Tables):
    return eventlog.read_events(t.spark, logged(t, bad_lines=True)).select("seq", "event", "run_id", "agent", "iteration", "status")


STATUS = f"""{LOG}, b AS (SELECT run_id, max(seq) FILTER (WHERE event = 'run_started') AS s, max(seq) FILTER (WHERE event = 'pipeline_complete') AS c,
   arg_max(agent, seq) FILTER (WHERE event = 'agent_report') AS current_agent, arg_max(iteration, seq) FILTER (WHERE event = 'iteration_started') AS iteration, arg_max(ts, seq) AS last_event_ts FROM lo GROUP BY run_id)"""
STATUS_ROWS = """SELECT run_id AS log, s IS NOT NULL AND (c IS NULL OR s > c) AS running, CASE WHEN s IS NOT NULL THEN run_id END AS run_id, current_agent, iteration, strftime(last_event_ts, '%Y-%m-%d %H:%M:%S') AS last_event_ts,
   CASE WHEN NOT (s IS NOT NULL AND (c IS NULL OR s > c)) THEN c END AS last_complete_seq FROM b"""


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("last_event_ts", F.date_format("last_event_ts", "yyyy-MM-dd HH:mm:ss"))


@query("E03_follow_events", f"WITH {STATUS} {STATUS_ROWS}")
def _(t: Tables):
    out, mark = scratch(t, "status"), scratch(t, "mark")
    events = eventlog.follow_events(t.spark, logged(t, bad_lines=True), files_per_batch=2)
    eventlog.status_stream(events, out, mark).awaitTermination()
    return _shown(eventlog.latest_status(t.spark, out))


@query("E04_status", f"WITH {STATUS} {STATUS_ROWS}")
def _(t: Tables):
    return _shown(eventlog.status(log(t), by="run_id"))


@query(
    "E05_last_reports",
    f"""WITH {LOG} SELECT agent, max(seq) AS seq, arg_max(iteration, seq) AS iteration, arg_max(status, seq) AS status, arg_max(array_to_string(issues, '; '), seq) AS issues, arg_max(recommendation, seq) AS recommendation
        FROM lo WHERE event = 'agent_report' GROUP BY agent""",
)
def _(t: Tables):
    return eventlog.last_reports(log(t)).withColumn("issues", F.array_join("issues", "; ")).drop("metrics")


@query("E05_agent_reports", f"WITH {LOG} SELECT seq, run_id, status FROM lo WHERE event = 'agent_report' AND agent = 'Clusterer'")
def _(t: Tables):
    return eventlog.agent_reports(log(t), "Clusterer").select("seq", "run_id", "status")


@query("E05_hard_blocks", f"WITH {LOG} SELECT run_id, bool_or(status = 'blocked' AND recommendation = 'escalate') AS hard_block FROM lo WHERE event = 'agent_report' GROUP BY run_id")
def _(t: Tables):
    return eventlog.hard_blocks(log(t))


@query(
    "E06_recent_summary",
    f"""WITH {LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS p FROM lo WHERE event = 'agent_report'),
        t AS (SELECT run_id, seq, concat_ws(' | ', '[Iter ' || coalesce(CAST(iteration AS VARCHAR), '?') || '] ' || agent || ' -> ' || upper(status), CASE WHEN len(issues) > 0 THEN 'Issues: ' || array_to_string(issues, '; ') END,
                'Recommendation: ' || recommendation) AS line FROM k WHERE p <= 5)
        SELECT run_id, string_agg(line, chr(10) ORDER BY seq) AS lines FROM t GROUP BY run_id""",
)
def _(t: Tables):
    return eventlog.recent_summary(log(t), last=5).withColumn("lines", F.array_join("lines", "\n"))


@query(
    "E07_usage",
    f"""WITH c AS (SELECT event_type AS agent, value AS time_s, user_id * 10 AS i, CAST(props ->> '$.k' AS BIGINT) AS o FROM events)
        SELECT agent, CAST(grouping(agent) AS INT) AS is_total, count(*) AS calls, {r('sum(time_s)', 4)} AS time_s, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens,
               {r('sum(time_s) / (SELECT sum(time_s) FROM c)', 6)} AS time_share, {r('sum(i) / 1e6 * 3 + sum(o) / 1e6 * 15', 4)} AS cost FROM c GROUP BY ROLLUP (agent)""",
)
def _(t: Tables):
    calls = t.events.select(
        F.col("event_type").alias("agent"), F.col("value").alias("time_s"), (F.col("user_id") * 10).alias("input_tokens"), F.from_json("props", "k LONG")["k"].alias("output_tokens")
    )
    out = eventlog.usage(calls).withColumn("is_total", F.col("is_total").cast("int"))
    return rounded(rounded(out, 6, ["time_share"]), 4, ["time_s", "cost"])


