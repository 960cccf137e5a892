"""Reading, profiling, role scoring and cleaning queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.operators import cleaning, profiling, roles
from cohortry.session import ensure_checkpoint_dir
from cohortry.sources import sinks, tables


def scratch(t: Tables, label: str) -> str:
    """A fresh folder name under the checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(t.spark)}/{label}-{uuid.uuid4().hex}"


# -- sources and sinks --------------------------------------------------------

ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@query("S01_load_delimited", f"SELECT {ORDER_COLUMNS} FROM orders")
def _(t: Tables):
    path = scratch(t, "orders") + "/orders.tsv"
    t.orders.select(*ORDER_COLUMNS.split(", ")).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return tables.load_table(t.spark, path, schema)


@query("S01_load_parquet", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t: Tables):
    df = tables.load_table(t.spark, f"{t.folder}/lineitem.parquet")
    return df.select("l_orderkey", "l_quantity")


@query("S02_row_id", "SELECT row_number() OVER (ORDER BY o_orderkey) AS _row_id, o_orderkey FROM orders")
def _(t: Tables):
    return tables.with_row_id(t.orders, "o_orderkey").select("_row_id", "o_orderkey")


@query("S03_route_by_format", "SELECT o_orderkey, 'features' AS mode FROM orders")
def _(t: Tables):
    stale = t.orders.select("o_orderkey", F.lit(3).alias("cluster"))
    mode, df = tables.route(stale, "orders.parquet")
    return df.withColumn("mode", F.lit(mode))


@query("S04_sample_rows", "SELECT least(5000, count(*)) AS n, CAST(0 AS BIGINT) AS strangers FROM orders")
def _(t: Tables):
    taken = tables.sample_rows(t.orders, "o_orderkey", n=5_000)
    strangers = taken.join(t.orders.withColumn("known", F.lit(1)).select("o_orderkey", "known"), "o_orderkey", "left")
    return strangers.agg(F.count_distinct("o_orderkey").alias("n"), F.count(F.when(F.col("known").isNull(), 1)).alias("strangers"))


@query("S05_preview", f"SELECT {ORDER_COLUMNS} FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t: Tables):
    return tables.preview(t.orders, "o_orderkey").select(*ORDER_COLUMNS.split(", "))


@query("S06_save_matrix", f"SELECT o_custkey, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY o_custkey")
def _(t: Tables):
    path = scratch(t, "matrix") + "/matrix"
    sinks.save_matrix(rounded(t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")), 2), path)
    return t.spark.read.parquet(path)


@query("S07_save_labels", "SELECT c_custkey AS row_index, CAST(c_nationkey AS INT) AS cluster_id FROM customer")
def _(t: Tables):
    path = scratch(t, "labels") + "/labels.csv"
    sinks.save_labels(t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("cluster_id")), path)
    return tables.load_table(t.spark, path, "row_index long, cluster_id int")


@query(
    "S10_iteration_snapshots",
    """SELECT 1 AS iteration, c_nationkey AS cluster_id, count(*) AS n FROM customer GROUP BY ALL
       UNION ALL SELECT 2, c_nationkey, count(*) + 1 FROM customer GROUP BY ALL""",
)
def _(t: Tables):
    path = scratch(t, "snapshots")
    sizes = t.customer.groupBy(F.col("c_nationkey").alias("cluster_id")).agg(F.count("*").alias("n"))
    for iteration, extra in ((1, 7), (2, 1), (1, 0)):  # iteration 1 is written twice: the second write wins
        sinks.append_snapshot(sizes.withColumn("n", F.col("n") + extra), path, iteration)
    return sinks.read_snapshots(t.spark, path).select("iteration", "cluster_id", "n")


@query(
    "S11_stage_preview",
    "SELECT 'engineered' AS stage, 1 AS iteration, c.column, n_rows, missing_pct, skew, array_to_string(head, '; ') AS head FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column, count(*) AS n_rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 2) AS missing_pct,
            {skew} AS skew, (SELECT list({c} ORDER BY p_partkey) FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 8)) AS head FROM part"""
        for c, skew in (("p_brand", "CAST(NULL AS DOUBLE)"), ("p_size", "round(skewness(p_size), 3)"), ("p_type", "CAST(NULL AS DOUBLE)"))
    )
    + ") c",
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_brand", "p_size", "p_type")
    out = sinks.stage_preview(df, "engineered", 1, "p_partkey").where(F.col("column") != "p_partkey")
    return out.withColumn("head", F.array_join("head", "; "))


@query(
    "S11_preview_history",
    """WITH snaps AS (SELECT event_type AS stage, user_id AS iteration, max(event_id) AS seq FROM events GROUP BY ALL)
       SELECT stage, iteration, seq FROM (
         SELECT stage, iteration, CASE WHEN stage = 'click' THEN seq + 1000000 ELSE seq END AS seq FROM snaps) ORDER BY seq DESC LIMIT 20""",
)
def _(t: Tables):
    snaps = t.events.groupBy(F.col("event_type").alias("stage"), F.col("user_id").alias("iteration")).agg(F.max("event_id").alias("seq"))
    fresh = snaps.where("stage = 'click'").withColumn("seq", F.col("seq") + 1_000_000)
    return sinks.upsert_previews(snaps, fresh)


@query("S12_load_corpus", "SELECT doc_id, lang FROM documents WHERE length(trim(text)) >= 20")
def _(t: Tables):
    return tables.load_corpus(t.documents).select("doc_id", "lang")


@query(
    "S13_benchmark_slice",
    """SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS p FROM documents
       WHERE lang IN ('en', 'fr', 'de') AND length(trim(text)) >= 120) WHERE p <= 50""",
)
def _(t: Tables):
    return tables.benchmark_slice(t.documents, "lang", ["en", "fr", "de"], 50, "doc_id").select("lang", "doc_id")


# -- column profile -----------------------------------------------------------

TYPES = {
    "lineitem": {
        "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric", "l_quantity": "numeric",
        "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "", "l_linestatus": "", "l_shipdate": "datetime",
    },
    "documents": {"doc_id": "numeric", "text": "", "lang": "", "source": "", "n_chars": "numeric"},
}


def _profile_sql(table: str) -> str:
    parts = []
    for c, kind in TYPES[table].items():
        dist = f"count(DISTINCT {c})"
        kind_sql = f"'{kind}'" if kind else f"CASE WHEN {dist} BETWEEN 1 AND 2 THEN 'binary' ELSE 'categorical' END"
        high = "FALSE" if kind else f"{dist} > 100"
        stats = (
            [r(f"{f}({c})", 4) for f in ("min", "max", "avg", "stddev_samp", "skewness")] if kind == "numeric" else ["CAST(NULL AS DOUBLE)"] * 5
        )
        names = ["min", "max", "mean", "std", "skewness"]
        miss = f"round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4)"
        parts.append(
            f"""SELECT '{c}' AS "column", {kind_sql} AS kind, {miss} AS missing, {miss} > 0.3 AS high_missing,
            {', '.join(f'{e} AS "{n}"' for e, n in zip(stats, names))}, {high} AS high_cardinality FROM {table}"""
        )
    return " UNION ALL ".join(parts)


def _typed(table: str, keep: str) -> str:
    return f"SELECT {keep} FROM ({_profile_sql(table)})"


for _table in TYPES:
    query(f"P01_column_types_{_table}", _typed(_table, '"column", kind'))(
        lambda t, n=_table: profiling.column_profile(getattr(t, n)).select("column", "kind")
    )
    query(f"P03_distribution_{_table}", _profile_sql(_table))(lambda t, n=_table: rounded(profiling.column_profile(getattr(t, n)), 4))


def _holed(t: Tables):
    """labels joined to documents: unlabelled documents leave gaps."""
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    return joined.withColumns({"empty": F.lit(None).cast("double"), "fixed": F.lit(7)})


HOLED = """(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic, CAST(NULL AS DOUBLE) AS empty, 7 AS fixed
            FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(
    "P02_missing_rates",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing,
        round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) > 0.3 AS high_missing FROM {HOLED}"""
        for c in ("doc_id", "lang", "n_chars", "quality", "toxic", "empty", "fixed")
    ),
)
def _(t: Tables):
    return profiling.column_profile(_holed(t)).select("column", "missing", "high_missing")


@query(
    "P04_high_cardinality",
    f"SELECT \"column\" FROM ({_profile_sql('documents')}) WHERE high_cardinality",
)
def _(t: Tables):
    return profiling.column_profile(t.documents).where("high_cardinality").select("column")


@query(
    "P05_profile_hints",
    f"""SELECT {r('avg(abs(skewness))', 3)} AS mean_abs_skew,
        CASE WHEN avg(abs(skewness)) > 2 THEN 'hierarchical' WHEN avg(abs(skewness)) < 0.5 THEN 'kmeans' ELSE 'hierarchical' END AS hint,
        array_to_string(list_filter([CASE WHEN bool_or(high_missing) THEN 'high_missing' END, CASE WHEN bool_or(high_cardinality) THEN 'high_cardinality' END,
          CASE WHEN count(*) FILTER (WHERE kind = 'numeric') < 5 THEN 'few_numeric' END,
          CASE WHEN avg(abs(skewness)) > 3 THEN 'high_skew' END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM ({_profile_sql('documents')})""",
)
def _(t: Tables):
    hints = profiling.profile_hints(profiling.column_profile(t.documents))
    return rounded(hints.withColumn("warnings", F.array_join("warnings", ",")), 3)


@query(
    "P06_histogram",
    f"""WITH v AS (SELECT o_totalprice AS x FROM orders), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM v),
        c AS (SELECT least(CAST(floor((x - lo) / w) AS INT), 29) AS bin, count(*) AS n FROM v, e GROUP BY 1)
        SELECT CAST(b.range AS INT) AS bin, {r('lo + b.range * w', 4)} AS low, {r('lo + (b.range + 1) * w', 4)} AS high, coalesce(n, 0) AS n
        FROM range(30) b CROSS JOIN e LEFT JOIN c ON c.bin = b.range""",
)
def _(t: Tables):
    return rounded(profiling.histogram(t.orders, "o_totalprice"), 4)


@query(
    "P06_column_summary",
    f"SELECT {r('min(x)', 4)} AS min, {r('max(x)', 4)} AS max, {r('avg(x)', 4)} AS mean, {r('median(x)', 4)} AS median, {r('stddev_pop(x)', 4)} AS std FROM (SELECT l_extendedprice AS x FROM lineitem)",
)
def _(t: Tables):
    return rounded(profiling.column_summary(t.lineitem, "l_extendedprice"), 4)


def _text_sql(min_tokens: int, min_unique: float) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", avg(coalesce(len(regexp_extract_all({c}, '\\S+')), 0)) AS avg_tokens,
            count(DISTINCT {c}) * 1.0 / greatest(count({c}), 1) AS uniqueness FROM documents WHERE {c} IS NOT NULL"""
        for c in ("text", "lang", "source")
    ]
    return f"""SELECT "column", {r('avg_tokens', 4)} AS avg_tokens, {r('uniqueness', 4)} AS uniqueness,
        {r('avg_tokens * (0.5 + 0.5 * uniqueness)', 4)} AS score,
        "column" = (SELECT max_by("column", avg_tokens * (0.5 + 0.5 * uniqueness)) FROM s WHERE avg_tokens >= {min_tokens} AND uniqueness >= {min_unique}) AS chosen
        FROM s""".replace("FROM s", "FROM sc", 2).join([f"WITH sc AS ({' UNION ALL '.join(parts)}) ", ""])


def _text(t: Tables, min_tokens: float, min_unique: float):
    scores = profiling.text_scores(t.documents)
    best = profiling.detect_text_column(scores, min_tokens, min_unique)
    out = scores.select("column", "avg_tokens", "uniqueness", "score", (F.col("column") == F.lit(best)).alias("chosen"))
    return rounded(out, 4)


query("P07_text_column", _text_sql(8, 0.5))(lambda t: _text(t, 8, 0.5))
query("P08_text_column_loose", _text_sql(5, 0.0))(lambda t: _text(t, 5, 0.0))


@query(
    "P09_modality",
    """SELECT 'documents' AS source, 'text' AS modality, 'text' AS text_column, FALSE AS blocked
       UNION ALL SELECT 'orders', 'tabular', NULL, FALSE
       UNION ALL SELECT 'documents_forced', 'tabular', NULL, FALSE
       UNION ALL SELECT 'pages_without_numbers', 'tabular', NULL, count(*) >= 0 FROM pages
       UNION ALL SELECT 'no_rows', 'tabular', NULL, TRUE""",
)
def _(t: Tables):
    found = [
        ("documents", profiling.route_modality(t.documents)),
        ("orders", profiling.route_modality(t.orders)),
        ("documents_forced", profiling.route_modality(t.documents, forced="tabular")),
        ("pages_without_numbers", profiling.route_modality(t.pages.select("url"))),
        ("no_rows", profiling.route_modality(t.orders.where("o_totalprice < 0"))),
    ]
    rows = [(n, d["modality"], d["text_column"], d["blocked"]) for n, d in found]
    return t.spark.createDataFrame(rows, "source string, modality string, text_column string, blocked boolean")


# -- roles ----------------------------------------------------------------------

ROLE_TABLES = {
    "orders": ("o_orderkey", {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "text", "o_totalprice": "num", "o_orderdate": "time", "o_orderpriority": "text"}),
    "events": ("event_id", {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "text", "value": "num", "props": "text"}),
}


def _role_sql(table: str, role: str, entity: str = "", timestamp: str = "") -> str:
    key, columns = ROLE_TABLES[table]
    parts = []
    for i, (c, k) in enumerate(columns.items()):
        lo, hi = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if k in ("int", "num") else ("NULL", "NULL")
        parse = (
            f"(SELECT avg(CASE WHEN TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) FROM {table} WHERE {c} IS NOT NULL)"
            if k == "text"
            else "NULL"
        )
        parts.append(
            f"SELECT '{c}' AS col, {i} AS pos, '{k}' AS k, count(DISTINCT {c}) AS d, count(DISTINCT {c}) * 1.0 / count(*) AS ratio, {lo} AS lo, {hi} AS hi, {parse} AS parsable FROM {table}"
        )
    words = ", ".join(f"('{w}')" for w in roles.ROLE_WORDS[role])
    name = f"""(SELECT sum(CASE WHEN w = replace(replace(lower(col), '_', ''), '-', '') THEN 100
                 WHEN contains(replace(replace(lower(col), '_', ''), '-', ''), w) THEN 50 ELSE 0 END) FROM (VALUES {words}) v(w))"""
    extra, where, tie = {
        "entity": ("CASE WHEN ratio >= 0.9 THEN 80 WHEN ratio >= 0.7 THEN 40 WHEN ratio >= 0.5 THEN 10 ELSE 0 END + CASE WHEN k = 'int' THEN 20 ELSE 0 END", "TRUE", "ratio"),
        "timestamp": ("CASE WHEN k = 'time' THEN 100 WHEN parsable >= 0.8 THEN 80 ELSE 0 END", "TRUE", "0"),
        "amount": ("CASE WHEN lo >= 0 THEN 30 ELSE 0 END + CASE WHEN hi > lo * 10 THEN 20 ELSE 0 END", f"k IN ('int', 'num') AND ratio < 0.95 AND d > 2 AND col <> '{entity}'", "0"),
        "category": ("CASE WHEN k = 'text' THEN 30 ELSE 0 END + CASE WHEN d <= 50 THEN 20 ELSE 0 END", f"d BETWEEN 2 AND 100 AND col NOT IN ('{entity}', '{timestamp}')", "0"),
    }[role]
    return f"""SELECT '{role}' AS role, CAST(place AS INT) AS place, col AS "column", CAST(score AS INT) AS score FROM (
        SELECT *, row_number() OVER (ORDER BY score DESC, {tie} DESC, pos) AS place FROM (
          SELECT *, {name} + {extra} AS score FROM ({' UNION ALL '.join(parts)}) WHERE {where}) WHERE score > 0) WHERE place <= 5"""


ROLE_IDS = {"P10_entity_role": "entity", "P11_timestamp_role": "timestamp", "P12_amount_role": "amount", "P13_category_role": "category"}
SETTLED = {"orders": ("o_orderkey", "o_orderdate"), "events": ("event_id", "ts")}
for _id, _role in ROLE_IDS.items():
    for _table in ROLE_TABLES:
        _e, _ts = SETTLED[_table]

        def _scores(t: Tables, table=_table, role=_role, e=_e, ts=_ts):
            stats = roles.column_statistics(getattr(t, table))
            found = roles.role_scores(stats, e, ts).where(F.col("role") == role)
            return found.select("role", F.col("place").cast("int").alias("place"), "column", F.col("score").cast("int").alias("score"))

        query(f"{_id}_{_table}", _role_sql(_table, _role, _e, _ts))(_scores)


@query(
    "P14_resolved_roles",
    """SELECT 'orders' AS source, 'o_orderkey' AS entity, 'o_orderdate' AS ts, 'o_custkey' AS amount, 'o_orderstatus' AS category, CAST(0 AS BIGINT) AS n_ambiguous
       FROM (SELECT count(*) FROM orders)
       UNION ALL SELECT 'part_numbers', 'p_size', NULL, 'p_size', 'p_size', 2 FROM (SELECT count(*) FROM part)""",
)
def _(t: Tables):
    rows = []
    for name, df, key in (("orders", t.orders, "o_orderkey"), ("part_numbers", t.part.select("p_size"), "p_size")):
        found, unsure = roles.resolve_roles(df, [key])
        rows.append((name, found.entity, found.timestamp, found.amount, found.category, len(unsure)))
    return t.spark.createDataFrame(rows, "source string, entity string, ts string, amount string, category string, n_ambiguous long")


@query(
    "P16_grouping_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", array_to_string(list_sort(list(DISTINCT {c})), ',') AS \"values\" FROM part HAVING count(DISTINCT {c}) BETWEEN 2 AND 200" for c in ("p_name", "p_brand", "p_type")
    ),
)
def _(t: Tables):
    return profiling.grouping_columns(t.part).withColumn("values", F.array_join("values", ","))


@query(
    "P17_control_gates",
    """WITH s AS (SELECT 'lineitem' AS source, count(*) AS n, (abs(skewness(l_orderkey)) + abs(skewness(l_partkey)) + abs(skewness(l_suppkey)) + abs(skewness(l_linenumber))
         + abs(skewness(l_quantity)) + abs(skewness(l_extendedprice)) + abs(skewness(l_discount)) + abs(skewness(l_tax))) / 8 AS k FROM lineitem
       UNION ALL SELECT 'supplier', count(*), (abs(skewness(s_suppkey)) + abs(skewness(s_nationkey)) + abs(skewness(s_acctbal))) / 3 FROM supplier
       UNION ALL SELECT 'documents', count(*), (abs(skewness(doc_id)) + abs(skewness(n_chars))) / 2 FROM documents)
       SELECT source, CAST(CASE WHEN k > 2 THEN greatest(0.25, p - 0.1) ELSE p END AS DOUBLE) AS max_cluster_size_pct, CAST(sk AS INT) AS sub_n_clusters,
              CAST(CASE WHEN k > 2 THEN least(3, d + 1) ELSE d END AS INT) AS max_depth
       FROM (SELECT *, CASE WHEN n < 1000 THEN 0.55 WHEN n < 50000 THEN 0.4 ELSE 0.3 END AS p, CASE WHEN n < 1000 THEN 2 ELSE 3 END AS sk,
                    CASE WHEN n < 1000 THEN 1 ELSE 2 END AS d FROM s)""",
)
def _(t: Tables):
    rows = []
    for name in ("lineitem", "supplier", "documents"):
        g = profiling.control_gates_of(getattr(t, name))
        rows.append((name, round(g["max_cluster_size_pct"], 4), g["sub_n_clusters"], g["max_depth"]))
    return t.spark.createDataFrame(rows, "source string, max_cluster_size_pct double, sub_n_clusters int, max_depth int")


SCORE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "P19_algorithm_scorecard",
    f"""WITH s AS (SELECT count(*) AS n, list_avg([{', '.join(f'abs(skewness({c}))' for c in SCORE_COLUMNS)}]) AS k,
            list_max([{', '.join(f'abs(skewness({c}))' for c in SCORE_COLUMNS)}]) AS mk FROM lineitem),
        p AS (SELECT CASE WHEN n > 100000 THEN 3.0 ELSE 0.0 END + 1.0 AS kmeans,
                     CASE WHEN n < 5000 THEN 1.0 ELSE 0.0 END + CASE WHEN k > 2 THEN 2.0 WHEN k > 1 THEN 1.0 ELSE 0.0 END + 2.0 AS hierarchical,
                     CASE WHEN mk > 5 THEN 1.0 ELSE 0.0 END + 2.0 AS dbscan FROM s),
        l AS (SELECT unnest(['kmeans', 'hierarchical', 'dbscan', 'gmm', 'fuzzy_cmeans', 'lda', 'nmf', 'llm_cluster']) AS algorithm,
                     unnest([kmeans, hierarchical, dbscan, 0.0, 0.0, 0.0, 0.0, 0.0]) AS score, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS pos FROM p)
        SELECT algorithm, CAST(score AS DOUBLE) AS score, pos = (SELECT pos FROM l ORDER BY score DESC, pos LIMIT 1) AS chosen FROM l""",
)
def _(t: Tables):
    from cohortry.functions.columns import col, g1_skew

    stats = t.lineitem.agg(F.count("*").alias("n"), *[g1_skew(col(c)).alias(c) for c in SCORE_COLUMNS]).first()
    card = profiling.algorithm_scorecard(stats["n"], 4, [stats[c] for c in SCORE_COLUMNS], "Simple tiers, and the noise around them")
    rows = [(a, float(s), a == card["algorithm"]) for a, s in card["scores"].items()]
    return t.spark.createDataFrame(rows, "algorithm string, score double, chosen boolean")


@query(
    "P20_outlier_features",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r(f'(max({c}) - min({c})) / (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-9)')} AS range_over_iqr, "
        f"(max({c}) - min({c})) / (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) + 1e-9) > 10 AS outlier_heavy FROM lineitem"
        for c in SCORE_COLUMNS
    ),
)
def _(t: Tables):
    return rounded(profiling.outlier_features(t.lineitem, SCORE_COLUMNS))


@query(
    "P21_multimodal_features",
    """WITH x AS (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders UNION ALL SELECT value * 1000 FROM events),
       s AS (SELECT count(x) AS n, min(x) AS lo, max(x) AS hi, stddev_samp(x) * pow(count(x), -0.2) AS w FROM x),
       v AS (SELECT x, count(*) AS c FROM x WHERE x IS NOT NULL GROUP BY x),
       d AS (SELECT i, sum(c * exp(-pow((lo + i * (hi - lo) / 199 - x) / w, 2) / 2)) AS d FROM range(200) t(i), s, v GROUP BY i),
       p AS (SELECT count(*) AS peaks FROM d a WHERE i BETWEEN 1 AND 198 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.i <> a.i AND abs(b.i - a.i) <= 10 AND b.d >= a.d))
       SELECT 'o_totalprice' AS feature, CAST(peaks AS INT) AS peaks, peaks >= 2 AS multimodal FROM p""",
)
def _(t: Tables):
    return profiling.multimodal_features(t.orders.select("o_totalprice").unionByName(t.events.select((F.col("value") * 1000).alias("o_totalprice"))))


@query(
    "P22_vectorizer_choice",
    """WITH s AS (SELECT count(*) AS n, avg(coalesce(len(regexp_extract_all(text, '\\S+')), 0)) AS a FROM documents),
       v AS (SELECT CASE WHEN a >= 40 THEN 2 ELSE 0 END + 1 AS tr, CASE WHEN a >= 40 THEN 0 ELSE 2 END + CASE WHEN n > 50000 THEN 1 ELSE 0 END AS tf FROM s)
       SELECT 'tfidf_svd' AS method, CASE WHEN tr > tf THEN 'transformer' ELSE 'tfidf_svd' END AS wanted,
              CAST(round(least(0.5 + 0.5 * abs(tr - tf) / (tr + tf), 1.0), 2) AS DOUBLE) AS confidence FROM v""",
)
def _(t: Tables):
    from cohortry.functions.columns import token_count

    s = t.documents.agg(F.count("*").alias("n"), F.avg(token_count(F.col("text"))).alias("a")).first()
    c = profiling.vectorizer_choice(s["n"], s["a"], "group by theme")
    return t.spark.createDataFrame([(c["method"], c["wanted"], float(c["confidence"]))], "method string, wanted string, confidence double")


# -- cleaning -------------------------------------------------------------------


@query("C01_duplicate_names", "SELECT o_orderkey, o_custkey FROM orders")
def _(t: Tables):
    twice = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("o_custkey"))
    return cleaning.drop_duplicate_names(twice)[0]


def _report_sql(columns, protect=()) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_fraction,
        {'CAST(NULL AS VARCHAR)' if c in protect else f"CASE WHEN count({c}) = 0 THEN 'all_null' WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 THEN 'high_null' WHEN count(DISTINCT {c}) <= 1 THEN 'constant' END"} AS dropped_as FROM {HOLED}"""
        for c in columns
    )


HOLED_COLUMNS = ("doc_id", "lang", "n_chars", "quality", "toxic", "empty", "fixed")


@query("C02_drop_null_columns", _report_sql(HOLED_COLUMNS))
def _(t: Tables):
    return cleaning.cleaning_report(_holed(t))


@query("C03_drop_constant_columns", f"SELECT \"column\" FROM ({_report_sql(HOLED_COLUMNS)}) WHERE dropped_as = 'constant'")
def _(t: Tables):
    return cleaning.cleaning_report(_holed(t)).where("dropped_as = 'constant'").select("column")


@query(
    "C04_cleaning_report",
    f"""SELECT count(*) AS n_before, count(*) FILTER (WHERE dropped_as IS NULL) AS n_after, count(*) FILTER (WHERE dropped_as = 'all_null') AS n_all_null,
        count(*) FILTER (WHERE dropped_as = 'high_null') AS n_high_null, count(*) FILTER (WHERE dropped_as = 'constant') AS n_constant
        FROM ({_report_sql(HOLED_COLUMNS, ('fixed',))})""",
)
def _(t: Tables):
    _, rep = cleaning.drop_low_value_columns(_holed(t), protect=["fixed"])
    row = (rep["n_cols_before"], rep["n_cols_after"], len(rep["dropped_all_null"]), len(rep["dropped_high_null"]), len(rep["dropped_constant"]))
    return t.spark.createDataFrame([row], "n_before long, n_after long, n_all_null long, n_high_null long, n_constant long")


def _priced(t: Tables):
    """Prices with gaps and an infinity."""
    x = F.when(F.col("l_returnflag") == "R", None).when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", x.alias("price"))


PRICED = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = 'R' OR l_discount = 0 THEN NULL ELSE l_extendedprice END AS price FROM lineitem)"""
for _strategy, _fill in (("median", "median(price)"), ("mean", "avg(price)"), ("zero", "max(0)")):
    query(
        f"C05_impute_{_strategy}",
        f"WITH {PRICED} SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, {r(f'coalesce(price, (SELECT {_fill} FROM p))', 4)} AS price FROM p",
    )(lambda t, s=_strategy: rounded(cleaning.impute_missing(_priced(t), s, ["price"])[0], 4, ["price"]))


@query(
    "C06_sanitize",
    """WITH h AS (SELECT d.doc_id, d.lang, d.n_chars, CASE WHEN d.n_chars > 2000 THEN d.n_chars END AS long_chars FROM documents d)
       SELECT doc_id, lang, n_chars, CAST(coalesce(long_chars, (SELECT median(long_chars) FROM h)) AS DOUBLE) AS long_chars FROM h""",
)
def _(t: Tables):
    df = t.documents.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 2000, F.col("n_chars")).alias("long_chars"))
    df = df.withColumns({"empty": F.lit(None).cast("double"), "fixed": F.lit("x")})
    return cleaning.sanitize(df, impute="median", max_null=0.9)[0]


@query("C07_clean_at_load", f"SELECT doc_id AS _row_id, lang, n_chars FROM {HOLED}")
def _(t: Tables):
    return cleaning.clean_loaded_table(_holed(t).drop("quality", "toxic").withColumnRenamed("doc_id", "_row_id"))[0]


@query(
    "C08_log_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) >= 0 AND abs(skewness({c})) > 2 AS logged, {r(f'CASE WHEN min({c}) >= 0 AND abs(skewness({c})) > 2 THEN avg(ln(1 + {c})) ELSE avg({c}) END', 4)} AS mean_after FROM (SELECT n_chars, n_chars * n_chars * 1.0 AS n_chars_sq, doc_id FROM documents)"
        for c in ("n_chars", "n_chars_sq", "doc_id")
    ),
)
def _(t: Tables):
    names = ["n_chars", "n_chars_sq", "doc_id"]
    df = t.documents.select("n_chars", (F.col("n_chars") * F.col("n_chars") * 1.0).alias("n_chars_sq"), "doc_id")
    logged = cleaning.log_columns(df, names)
    done = cleaning.log_transform(df, logged)
    out = done.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(c in logged).alias("logged"), F.avg(c).alias("mean_after")) for c in names]).alias("a"))
    return rounded(out.select(F.explode("a").alias("s")).select("s.*"), 4)


@query(
    "C09_standardise",
    f"""SELECT p_partkey, {r('(p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part)')} AS p_size,
        {r('(p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_pop(p_retailprice) FROM part)')} AS p_retailprice,
        CAST(0 AS DOUBLE) AS flat FROM part""",
)
def _(t: Tables):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", F.lit(3.0).alias("flat"))
    return rounded(cleaning.standardise(df, ["p_size", "p_retailprice", "flat"]))


@query(
    "C10_unit_rows",
    f"""WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
        n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS norm FROM u GROUP BY vec_id)
        SELECT u.vec_id, CAST(pos AS INT) AS pos, {r('CAST(x AS DOUBLE) / norm', 5)} AS value FROM u JOIN n ON u.vec_id = n.vec_id""",
)
def _(t: Tables):
    df = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    long = cleaning.unit_rows(df).select("vec_id", F.posexplode("features").alias("pos", "value"))
    return rounded(long.withColumn("pos", F.col("pos") + 1), 5)


@query(
    "C11_prepare_matrix",
    f"""WITH {PRICED} SELECT l_orderkey, l_linenumber, l_partkey, {r('l_quantity', 4)} AS l_quantity, {r('coalesce(price, (SELECT median(price) FROM p))', 4)} AS price FROM p""",
)
def _(t: Tables):
    df = _priced(t).withColumn("void", F.lit(float("inf")))
    done, _names = cleaning.prepare_matrix(df, ["l_quantity", "price", "void"])
    return rounded(done, 4, ["l_quantity", "price"])
