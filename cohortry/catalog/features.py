"""Feature builders on orders: customer, order date, total price, order priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog.base import Tables, query, r, rounded
from cohortry.operators import features as fx
from cohortry.operators.features import Roles, event_frame
from cohortry.plans.feature_plan import build_features, default_plan

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
ROLES = Roles("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", ("o_orderkey",))

EV = """
ev AS (SELECT o_custkey, CAST(o_orderdate AS TIMESTAMP) AS ts, o_totalprice AS amt, o_orderpriority AS cat, o_orderkey,
              o_orderstatus FROM orders),
mx AS (SELECT max(ts) AS m FROM ev),
spine AS (SELECT DISTINCT o_custkey FROM ev)"""


def name_of(priority: str) -> str:
    return priority.replace("-", "_").replace(" ", "_")


def inside(window, ts: str = "ts") -> str:
    return "TRUE" if window == "all" else f"{ts} >= (SELECT m - INTERVAL {window} MONTH FROM mx)"


def lab(window) -> str:
    return fx.label_of(window)


def frame(t: Tables):
    return event_frame(t.orders, ROLES)


def filled(built):
    """A single builder's output, as the matrix would hold it."""
    df, names = built
    return rounded(df.select("o_custkey", *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]), 4)


def z(expr: str, name: str) -> str:
    return f'{r(f"coalesce({expr}, 0)", 4)} AS "{name}"'


# -- parsing and windows ----------------------------------------------------


@query(
    "F01_timestamp_coercion",
    """SELECT count(*) AS n_rows, count(ts) AS n_parsed, min(ts) AS first_ts, max(ts) AS last_ts
       FROM (SELECT TRY_CAST(props ->> '$.k' AS BIGINT) AS k,
                    TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS ts
             FROM events) WHERE ts IS NOT NULL""",
)
def _(t: Tables):
    text = t.events.select(
        F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("when")
    )
    parsed = fx.parse_timestamps(text, "when")
    return parsed.agg(
        F.count("*").alias("n_rows"), F.count("_ts").alias("n_parsed"), F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts")
    )


@query(
    "F02_time_window",
    "WITH " + EV + " SELECT o_orderkey, o_custkey FROM ev WHERE " + inside(6),
)
def _(t: Tables):
    return fx.window_rows(frame(t), 6).select("o_orderkey", "o_custkey")


# -- per category -----------------------------------------------------------


def _group_sql(windows, metrics) -> str:
    cols = []
    for w in windows:
        for p in PRIORITIES:
            hit = f"cat = '{p}' AND {inside(w)}"
            n = f"count(amt) FILTER (WHERE {hit})"
            span = f"date_diff('second', min(ts) FILTER (WHERE {hit}), max(ts) FILTER (WHERE {hit}))"
            expr = {
                "count": n,
                "sum": f"sum(amt) FILTER (WHERE {hit})",
                "mean": f"avg(amt) FILTER (WHERE {hit})",
                "median": f"median(amt) FILTER (WHERE {hit})",
                "std": f"stddev_samp(amt) FILTER (WHERE {hit})",
                "max": f"max(amt) FILTER (WHERE {hit})",
                "freq": f"{n} / greatest(CAST(floor({span} / 86400.0) AS DOUBLE), 1.0)",
                "pct_count": f"{n} * 1.0 / nullif(count(amt) FILTER (WHERE {inside(w)}), 0)",
                "pct_sum": f"sum(amt) FILTER (WHERE {hit}) / nullif(sum(amt) FILTER (WHERE {inside(w)}), 0)",
            }
            cols += [z(expr[m], f"{m}_{name_of(p)}_{lab(w)}") for m in metrics]
    return f"WITH {EV} SELECT o_custkey, {', '.join(cols)} FROM ev GROUP BY o_custkey"


def _group(t: Tables, windows, metrics):
    fr = frame(t)
    built, names = fx.group_aggregate(fr, "o_orderpriority", "o_totalprice", windows=windows, metrics=metrics)
    return filled((fr.events.select("o_custkey").distinct().join(built, "o_custkey", "left"), names))


for _name, _windows, _metrics in [
    ("F03_group_aggregate", [6, 12], ["count", "sum", "mean"]),
    ("F03_group_aggregate_spread", ["all"], ["median", "std", "max"]),
    ("F04_group_frequency", [12, "all"], ["freq"]),
    ("F05_group_shares", [12, "all"], ["pct_count", "pct_sum"]),
]:
    query(_name, _group_sql(_windows, _metrics))(lambda t, w=_windows, m=_metrics: _group(t, w, m))


def _trend_sql() -> str:
    cols, fills = [], []
    for p in PRIORITIES:
        b, c = f"cat = '{p}' AND {inside(6)}", f"cat = '{p}' AND {inside(12)}"
        for m, agg in (("count", "count(amt)"), ("sum", "sum(amt)")):
            both = f"count(*) FILTER (WHERE {b}) > 0 AND count(*) FILTER (WHERE {c}) > 0"
            cols.append(
                f"CASE WHEN {both} THEN {agg} FILTER (WHERE {b}) / ({agg} FILTER (WHERE {c}) + 1.0) ELSE 1.0 END AS trend_{m}_{name_of(p)}"
            )
            fills.append(z(f"trend_{m}_{name_of(p)}", f"trend_{m}_{name_of(p)}"))
    return f"""WITH {EV}, tr AS (SELECT o_custkey, {', '.join(cols)} FROM ev WHERE {inside(12)} GROUP BY o_custkey)
    SELECT spine.o_custkey, {', '.join(fills)} FROM spine LEFT JOIN tr ON spine.o_custkey = tr.o_custkey"""


@query("F06_group_trend", _trend_sql())
def _(t: Tables):
    fr = frame(t)
    built, names = fx.group_trend(fr, "o_orderpriority", "o_totalprice")
    return filled((fr.events.select("o_custkey").distinct().join(built, "o_custkey", "left"), names))


_streaks = ", ".join(z(f"max(run) FILTER (WHERE cat = '{p}')", f"streak_{name_of(p)}") for p in PRIORITIES)


STREAKS = f"""WITH {EV},
    mon AS (SELECT DISTINCT o_custkey, cat, year(ts) * 12 + month(ts) AS m FROM ev),
    isl AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey, cat ORDER BY m) AS g FROM mon),
    runs AS (SELECT o_custkey, cat, g, count(*) AS run FROM isl GROUP BY ALL)
    SELECT o_custkey, {_streaks} FROM runs GROUP BY o_custkey"""


@query("F07_group_streak", STREAKS)
def _(t: Tables):
    return filled(fx.group_streak(frame(t), "o_orderpriority"))


# -- per entity -------------------------------------------------------------


def _overall_sql(windows) -> str:
    cols = []
    for w in windows:
        hit, tail = inside(w), f"o_totalprice_{lab(w)}"
        f = f"FILTER (WHERE {hit})"
        cols += [
            z(f"sum(amt) {f}", f"sum_{tail}"),
            z(f"avg(amt) {f}", f"mean_{tail}"),
            z(f"stddev_samp(amt) {f}", f"std_{tail}"),
            z(f"max(amt) {f}", f"max_{tail}"),
            z(f"median(amt) {f}", f"median_{tail}"),
            z(
                f"count(*) FILTER (WHERE {hit} AND amt > (SELECT p75 FROM hi)) * 1.0 / nullif(count(amt) {f}, 0)",
                f"pct_high_{tail}",
            ),
        ]
    return f"""WITH {EV}, hi AS (SELECT quantile_cont(amt, 0.75) AS p75 FROM ev)
    SELECT o_custkey, {', '.join(cols)} FROM ev GROUP BY o_custkey"""


@query("F08_overall_aggregate", _overall_sql([6, 12, "all"]))
def _(t: Tables):
    return filled(fx.overall_aggregate(frame(t), "o_totalprice"))


def _frequency_sql(source: str, entity: str, windows) -> str:
    gaps, cols = [], []
    for w in windows:
        gaps.append(f"""g_{lab(w)} AS (SELECT {entity}, count(*) AS n, count(DISTINCT year(ts) * 12 + month(ts)) AS months,
            sum(floor(gap / 86400000000.0)) AS gaps FROM (
              SELECT {entity}, ts, date_diff('microsecond', lag(ts) OVER (PARTITION BY {entity} ORDER BY ts), ts) AS gap
              FROM ev WHERE {inside(w)}) GROUP BY {entity})""")
        cols += [
            z(f"g_{lab(w)}.n", f"event_count_{lab(w)}"),
            z(f"g_{lab(w)}.months", f"active_periods_{lab(w)}"),
            z(f"CASE WHEN g_{lab(w)}.n > 1 THEN g_{lab(w)}.gaps / (g_{lab(w)}.n - 1) ELSE 0 END", f"avg_gap_days_{lab(w)}"),
        ]
    joins = " ".join(f"LEFT JOIN g_{lab(w)} ON last.{entity} = g_{lab(w)}.{entity}" for w in windows)
    return f"""WITH {source}, {', '.join(gaps)},
    last AS (SELECT {entity}, floor(date_diff('microsecond', max(ts), (SELECT m FROM mx)) / 86400000000.0) AS days FROM ev GROUP BY {entity})
    SELECT last.{entity}, {z('last.days', 'days_since_last')}, {', '.join(cols)} FROM last {joins}"""


@query("F09_frequency_recency", _frequency_sql(EV, "o_custkey", [6, 12, "all"]))
def _(t: Tables):
    return filled(fx.frequency_recency(frame(t)))


@query(
    "F09_frequency_recency_events",
    _frequency_sql("ev AS (SELECT user_id, ts FROM events), mx AS (SELECT max(ts) AS m FROM ev)", "user_id", ["all"]),
)
def _(t: Tables):
    built, names = fx.frequency_recency(event_frame(t.events, Roles("user_id", "ts", "value", "event_type")), windows=["all"])
    return rounded(built.select("user_id", *[F.col(n).cast("double").alias(n) for n in names]), 4)


_diversity = ", ".join(
    z(f"count(DISTINCT {c}) FILTER (WHERE {inside(w)})", f"n_unique_{n}_{lab(w)}")
    for w in [6, 12, "all"]
    for c, n in (("cat", "o_orderpriority"), ("o_orderstatus", "o_orderstatus"))
)


@query("F10_entity_diversity", f"WITH {EV} SELECT o_custkey, {_diversity} FROM ev GROUP BY o_custkey")
def _(t: Tables):
    return filled(fx.entity_diversity(frame(t), ["o_orderpriority", "o_orderstatus"]))


def _share(cond: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) * 1.0 / count(*)"


def _temporal_sql(source: str, entity: str) -> str:
    shares = [
        z(_share("hour(ts) >= 6 AND hour(ts) < 12"), "pct_morning_all"),
        z(_share("hour(ts) >= 12 AND hour(ts) < 18"), "pct_midday_all"),
        z(_share("hour(ts) >= 18"), "pct_evening_all"),
        z(_share("hour(ts) < 6"), "pct_night_all"),
        z(_share("isodow(ts) >= 6"), "pct_weekend_all"),
        z("max(h.peak)", "peak_hour_all"),
    ]
    return f"""WITH {source} SELECT {entity}, {', '.join(shares)} FROM ev JOIN (SELECT {entity} AS u, min(hh) AS peak FROM (
            SELECT {entity}, hour(ts) AS hh, count(*) AS n, max(count(*)) OVER (PARTITION BY {entity}) AS best
            FROM ev GROUP BY {entity}, hour(ts)) WHERE n = best GROUP BY {entity}) h ON h.u = {entity}
        GROUP BY {entity}"""


@query("F11_temporal_patterns", _temporal_sql("ev AS (SELECT user_id, ts FROM events)", "user_id"))
def _(t: Tables):
    built, names = fx.temporal_patterns(event_frame(t.events, Roles("user_id", "ts", "value", "event_type")))
    return rounded(built.select("user_id", *[F.col(n).cast("double").alias(n) for n in names]), 4)


@query(
    "F12_static_attributes",
    f"""SELECT l_suppkey, {z('avg(l_tax)', 'l_tax')}, {z('avg(l_linenumber)', 'l_linenumber')},
        {z("arg_min(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END, (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice))", 'l_linestatus_O')}
        FROM lineitem GROUP BY l_suppkey""",
)
def _(t: Tables):
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    fr = event_frame(t.lineitem, Roles("l_suppkey", "l_shipdate", "l_extendedprice", None, order))
    built, names = fx.static_attributes(fr, ["l_tax", "l_linenumber", "l_linestatus", "l_returnflag"])
    return rounded(built.select("l_suppkey", *[F.col(n).cast("double").alias(n) for n in names]), 4)


# -- plans ------------------------------------------------------------------


@query(
    "F13_plan_execution",
    f"""WITH {EV},
    a AS (SELECT o_custkey, sum(amt) AS s6 FROM ev WHERE {inside(6)} GROUP BY o_custkey),
    b AS (SELECT o_custkey, sum(amt) AS sa, count(DISTINCT cat) AS d FROM ev GROUP BY o_custkey)
    SELECT b.o_custkey, {z('s6', 'sum_o_totalprice_6m')}, {z('sa', 'sum_o_totalprice_all')}, {z('d', 'n_unique_o_orderpriority_all')}
    FROM b LEFT JOIN a ON a.o_custkey = b.o_custkey""",
)
def _(t: Tables):
    plan = [
        {"builder": "overall_spend", "params": {"windows": [6, "all"]}},
        {"builder": "entity_diversity", "params": {"windows": ["all"]}},
        {"builder": "overall_aggregate", "params": {"value_col": "no_such_column"}},
        {"builder": "not_a_builder", "params": {}},
        {"builder": "overall_value", "params": {"windows": ["all"]}},
    ]
    built = build_features(t.orders, ROLES, plan)
    return rounded(built.select("o_custkey", "sum_o_totalprice_6m", "sum_o_totalprice_all", "n_unique_o_orderpriority_all"), 4)


_parts = [_group_sql([6, 12], ["count", "sum", "mean"]), _trend_sql(), STREAKS, _overall_sql([6, 12, "all"]), _frequency_sql(EV, "o_custkey", [6, 12, "all"]), _temporal_sql(EV, "o_custkey")]


@query("F14_default_plan", "SELECT * FROM " + " JOIN ".join(f"({sql}) p{i}" + (" USING (o_custkey)" if i else "") for i, sql in enumerate(_parts)))
def _(t: Tables):
    return rounded(build_features(t.orders, ROLES, default_plan(True)), 4)


@query(
    "F15_category_values",
    "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW', '9-UNKNOWN')",
)
def _(t: Tables):
    return fx.category_values(t.orders, "o_orderpriority", ["1-URGENT", "5-LOW", "9-UNKNOWN"])


@query(
    "F16_matrix_gate",
    f"""WITH {EV}, f AS (SELECT o_custkey, count(amt) AS a, max(amt) AS b, 1 AS c FROM ev GROUP BY o_custkey)
    SELECT 3 AS n_features, CAST((count(DISTINCT a) > 2) AS INT) + CAST((count(DISTINCT b) > 2) AS INT) + CAST((count(DISTINCT c) > 2) AS INT)
           AS n_multi_level, FALSE AS blocked, TRUE AS blocked_at_20 FROM f""",
)
def _(t: Tables):
    m = t.orders.groupBy("o_custkey").agg(F.count("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.lit(1).alias("c"))
    gate, strict = fx.matrix_gate(m, "o_custkey", min_features=3), fx.matrix_gate(m, "o_custkey")
    row = (gate["n_features"], gate["n_multi_level"], gate["blocked"], strict["blocked"])
    return t.spark.createDataFrame([row], "n_features int, n_multi_level int, blocked boolean, blocked_at_20 boolean")
