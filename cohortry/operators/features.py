"""Entity-level behaviour features from an event table.

The builders are compiled together rather than run one after another: every
requested (metric, category, window) becomes a conditional aggregate, so the
events are scanned once per grouping key instead of once per window, category
and metric.  All joins are on the entity key and reuse its partitioning.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col, month_index, safe_name, string_columns, unique_names, whole_days
from cohortry.functions.moments import column_moments
from cohortry.functions.quantiles import HOT_GROUP_ROWS, exact_quantiles, group_medians
from cohortry.operators.profiling import distinct_counts
from cohortry.session import MAX_PIVOT_VALUES, take_bounded

NO_TIMESTAMP = datetime(2020, 1, 1)  # stands in when the table has no time column
MIN_FEATURES = 20


@dataclass(frozen=True)
class Roles:
    """Which column plays which part in the event table."""

    entity: str
    timestamp: str | None = None
    amount: str | None = None
    category: str | None = None
    order: tuple[str, ...] = ()  # columns that define "first row per entity"


@dataclass
class EventFrame:
    """Events with a parsed ``_ts`` and the few scalars that every builder needs."""

    events: DataFrame
    roles: Roles
    latest: datetime
    hot_rows: int = HOT_GROUP_ROWS
    _categories: dict[str, list] = field(default_factory=dict)
    _medians: dict[str, tuple[str, int | str]] = field(default_factory=dict)  # feature -> (value column, window)

    @property
    def entity(self) -> str:
        return self.roles.entity

    def cutoff(self, window: int | str) -> datetime | None:
        return None if window == "all" else months_before(self.latest, int(window))

    def inside(self, window: int | str, ts: Column | None = None) -> Column:
        edge = self.cutoff(window)
        if edge is None:
            return F.lit(True)
        return (F.col("_ts") if ts is None else ts) >= F.lit(edge).cast("timestamp_ntz")

    def categories(self, column: str) -> list:
        if column not in self._categories:
            values = self.events.select(col(column).alias("v")).where("v is not null").distinct()
            rows = take_bounded(values, MAX_PIVOT_VALUES, f"distinct values of {column}")
            self._categories[column] = sorted(r["v"] for r in rows)
        return self._categories[column]


def months_before(moment: datetime, months: int) -> datetime:
    """Calendar subtraction that keeps the time of day and clips to the month's last day."""
    index = moment.year * 12 + moment.month - 1 - months
    year, month = divmod(index, 12)
    day = min(moment.day, calendar.monthrange(year, month + 1)[1])
    return moment.replace(year=year, month=month + 1, day=day)


def label_of(window: int | str) -> str:
    return "all" if window == "all" else f"{window}m"


def parse_timestamps(events: DataFrame, timestamp: str | None) -> DataFrame:
    """Add ``_ts``; rows whose timestamp cannot be read are dropped."""
    if timestamp is None:
        return events.withColumn("_ts", F.lit(NO_TIMESTAMP).cast("timestamp_ntz"))
    return events.withColumn("_ts", col(timestamp).try_cast("timestamp_ntz")).where("_ts is not null")


def event_frame(events: DataFrame, roles: Roles, hot_rows: int = HOT_GROUP_ROWS) -> EventFrame:
    parsed = parse_timestamps(events, roles.timestamp).where(col(roles.entity).isNotNull())
    latest = parsed.agg(F.max("_ts")).first()[0]
    return EventFrame(parsed, roles, latest or NO_TIMESTAMP, hot_rows)


def category_values(events: DataFrame, column: str, requested: list | None = None) -> DataFrame:
    """Sorted distinct non-null values, optionally only the requested ones."""
    values = events.select(col(column).alias(column)).where(col(column).isNotNull()).distinct()
    if requested is not None:
        values = values.where(col(column).isin(list(requested)))
    return values.orderBy(column)


def window_rows(frame: EventFrame, window: int | str) -> DataFrame:
    """The events inside one time window, anchored at the latest event of the whole table."""
    return frame.events.where(frame.inside(window))


# ---------------------------------------------------------------------------
# builders: each returns (entity-keyed frame, ordered feature names)
# ---------------------------------------------------------------------------

METRIC_NAMES = {  # accepted spellings -> name used in the feature
    "count": "count", "n_event": "count",
    "total": "sum", "sum": "sum",
    "avg": "mean", "average": "mean", "mean": "mean",
    "median": "median", "std": "std", "max": "max",
    "frequency": "freq", "freq": "freq",
    "pct_count": "pct_count", "pct_sum": "pct_sum",
}


def _requested(frame: EventFrame, column: str, spec) -> list:
    available = frame.categories(column)
    return available if spec in (None, "all") else [c for c in spec if c in available]


def _pivoted(frame: EventFrame, per_group: DataFrame, column: str, outputs: list[tuple[str, object, Column]], extra=()) -> DataFrame:
    """Second-level aggregate: one row per entity, one column per (category value, expression)."""
    picks = [F.max(F.when(col(column) == F.lit(value), expr)).alias(name) for name, value, expr in outputs]
    return per_group.groupBy(col(frame.entity).alias(frame.entity)).agg(*picks, *extra)


def _group_expressions(frame: EventFrame, amount: Column, window, metrics: set[str]) -> dict[str, Column]:
    """Conditional aggregates of one window, per (entity, category)."""
    lab, hit = label_of(window), frame.inside(window)
    x = F.when(hit, amount)
    out = {f"_rows_{lab}": F.count(F.when(hit, 1)), f"_count_{lab}": F.count(x)}
    if {"sum", "pct_sum"} & metrics:
        out[f"_sum_{lab}"] = F.coalesce(F.sum(x), F.lit(0)).cast("double")
    if "mean" in metrics:
        out[f"_mean_{lab}"] = F.avg(x)
    if "std" in metrics:
        out[f"_std_{lab}"] = F.stddev_samp(x)
    if "max" in metrics:
        out[f"_max_{lab}"] = F.max(x)
    if "freq" in metrics:
        seen = F.when(hit, F.col("_ts"))
        out[f"_freq_{lab}"] = F.count(x) / F.greatest(whole_days(F.max(seen), F.min(seen)), F.lit(1))
    return out


def group_features(frame: EventFrame, group_col: str, value_col: str, steps: list[dict]) -> tuple[DataFrame, list[list[str]]]:
    """All category aggregates and trends over one (entity, category) grouping.

    Each step is ``{"kind": "aggregate", categories, windows, metrics}`` or
    ``{"kind": "trend", categories, base_window, compare_window}``.  Whatever the
    steps ask for becomes one aggregate and one pivot; the names of each step's
    features come back in step order.
    """
    plans, needed = [], {}
    for step in steps:
        values = _requested(frame, group_col, step.get("categories", "all"))
        if step["kind"] == "trend":
            windows, metrics = [step.get("base_window", 6), step.get("compare_window", 12)], ["count", "sum"]
        else:
            windows = list(dict.fromkeys(step.get("windows", [6, 12])))
            metrics = [m for m in dict.fromkeys(METRIC_NAMES.get(m) for m in step.get("metrics", ["count", "sum", "mean"])) if m]
        plans.append((step["kind"], values, windows, metrics))
        if values:
            for w in windows:
                needed.setdefault(w, set()).update(metrics)
    every = sorted({v for _, values, _, _ in plans for v in values})
    names = unique_names(frame.categories(group_col))
    if not needed:
        return frame.events.select(frame.entity).distinct(), [[] for _ in steps]
    asked = set().union(*needed.values())
    shares = {m for m in ("count", "sum") if f"pct_{m}" in asked}
    widest = F.lit(False)
    for w in needed:
        widest = widest | frame.inside(w)
    rows = frame.events.where(widest)  # the widest window reaches the scan
    if not shares:  # shares need the entity's total over all categories
        rows = rows.where(col(group_col).isin(every))
    keys = [frame.entity, group_col]
    aggregates: dict[str, Column] = {}
    for w, metrics in needed.items():
        aggregates.update(_group_expressions(frame, col(value_col), w, metrics))
    per_group = rows.groupBy(*[col(k).alias(k) for k in keys]).agg(*[e.alias(n) for n, e in aggregates.items()])
    middles = [w for w, metrics in needed.items() if "median" in metrics]
    if middles:
        shaped = rows.where(col(group_col).isin(every)).select(
            *keys, *[F.when(frame.inside(w), col(value_col)).alias(f"_x_{label_of(w)}") for w in middles]
        )
        medians = group_medians(shaped, keys, {f"_median_{label_of(w)}": f"_x_{label_of(w)}" for w in middles}, frame.hot_rows)
        per_group = per_group.join(medians, keys, "left")

    picks: dict[str, tuple[object, Column]] = {}
    extra: dict[str, Column] = {}
    final: list[dict[str, Column]] = []
    for at, (kind, values, windows, metrics) in enumerate(plans):
        shown: dict[str, Column] = {}
        if kind == "trend" and values:
            base, comp = label_of(windows[0]), label_of(windows[1])
            both = (F.col(f"_rows_{base}") > 0) & (F.col(f"_rows_{comp}") > 0)
            present = (F.col(f"_rows_{base}") > 0) | (F.col(f"_rows_{comp}") > 0)
            extra[f"_known_{at}"] = F.max((present & col(group_col).isin(values)).cast("int"))
            for v in values:
                for m in ("count", "sum"):
                    name = f"trend_{m}_{names[v]}"
                    picks[f"_{at}_{name}"] = (v, F.when(both, F.col(f"_{m}_{base}") / (F.col(f"_{m}_{comp}") + 1)))
                    shown[name] = F.when(F.col(f"_known_{at}") == 1, F.coalesce(F.col(f"_{at}_{name}"), F.lit(1.0)))
        elif kind == "aggregate":
            for w in windows:
                lab = label_of(w)
                for v in values:
                    for m in metrics:
                        name = f"{m}_{names[v]}_{lab}"
                        if m.startswith("pct_"):
                            base = m[4:]
                            picks[f"_part_{name}"] = (v, F.col(f"_{base}_{lab}"))
                            extra[f"_total_{base}_{lab}"] = F.sum(f"_{base}_{lab}")
                            total = F.col(f"_total_{base}_{lab}")
                            shown[name] = F.when(total != 0, F.col(f"_part_{name}") / total)
                        else:
                            picks[f"_pick_{name}"] = (v, F.when(F.col(f"_rows_{lab}") > 0, F.col(f"_{m}_{lab}")))
                            shown[name] = F.col(f"_pick_{name}")
        final.append(shown)
    wide = _pivoted(frame, per_group, group_col, [(n, v, e) for n, (v, e) in picks.items()], [e.alias(n) for n, e in extra.items()])
    columns: dict[str, Column] = {}
    for shown in final:
        for n, e in shown.items():
            columns.setdefault(n, e)
    return wide.select(frame.entity, *[e.alias(n) for n, e in columns.items()]), [list(shown) for shown in final]


def group_aggregate(
    frame: EventFrame,
    group_col: str,
    value_col: str,
    categories="all",
    windows=(6, 12),
    metrics=("count", "sum", "mean"),
) -> tuple[DataFrame, list[str]]:
    """Count, sum, mean, median, std, max, frequency and share per category and window."""
    step = {"kind": "aggregate", "categories": categories, "windows": windows, "metrics": metrics}
    built, names = group_features(frame, group_col, value_col, [step])
    return built, names[0]


def group_trend(
    frame: EventFrame, group_col: str, value_col: str, categories="all", base_window=6, compare_window=12
) -> tuple[DataFrame, list[str]]:
    """Recent activity over longer activity, per category; 1.0 means no evidence of change."""
    step = {"kind": "trend", "categories": categories, "base_window": base_window, "compare_window": compare_window}
    built, names = group_features(frame, group_col, value_col, [step])
    return built, names[0]


def group_streak(frame: EventFrame, group_col: str, categories="all") -> tuple[DataFrame, list[str]]:
    """Longest run of consecutive calendar months with a row, per category (gaps and islands)."""
    values = _requested(frame, group_col, categories)
    if not values:
        return frame.events.select(frame.entity).distinct(), []
    names = unique_names(values)
    keys = [frame.entity, group_col]
    months = (
        frame.events.where(col(group_col).isin(values))
        .select(*[col(k).alias(k) for k in keys], month_index(F.col("_ts")).alias("_m"))
        .distinct()
    )
    island = F.col("_m") - F.row_number().over(Window.partitionBy(*keys).orderBy("_m"))
    runs = months.withColumn("_island", island).groupBy(*keys, "_island").agg(F.count("*").alias("_run"))
    longest = runs.groupBy(*keys).agg(F.max("_run").alias("_run"))
    order = [f"streak_{names[v]}" for v in values]
    return _pivoted(frame, longest, group_col, [(f"streak_{names[v]}", v, F.col("_run")) for v in values]), order


def _overall_columns(frame: EventFrame, value_col: str, windows) -> dict[str, Column]:
    amount = col(value_col)
    high = exact_quantiles(frame.events, {value_col: [0.75]})[value_col][0]
    name = safe_name(value_col)
    out: dict[str, Column] = {}
    for w in windows:
        lab = label_of(w)
        x = F.when(frame.inside(w), amount)
        above = F.count(F.when(x > F.lit(high), 1)) if high is not None else F.lit(0)
        out[f"sum_{name}_{lab}"] = F.sum(x)
        out[f"mean_{name}_{lab}"] = F.avg(x)
        out[f"std_{name}_{lab}"] = F.stddev_samp(x)
        out[f"max_{name}_{lab}"] = F.max(x)
        out[f"median_{name}_{lab}"] = F.percentile(x, F.lit(0.5))
        frame._medians[f"median_{name}_{lab}"] = (value_col, w)
        out[f"pct_high_{name}_{lab}"] = F.when(F.count(x) > 0, above / F.count(x))
    return out


def _temporal_columns(frame: EventFrame, windows) -> dict[str, Column]:
    hour, weekend = F.hour("_ts"), F.weekday("_ts") >= 5
    buckets = {"morning": (6, 12), "midday": (12, 18), "evening": (18, 24), "night": (0, 6)}  # fixed values
    out: dict[str, Column] = {}
    for w in windows:
        lab, hit = label_of(w), frame.inside(w)
        n = F.count(F.when(hit, 1))
        for bucket, (lo, hi) in buckets.items():
            out[f"pct_{bucket}_{lab}"] = F.when(n > 0, F.count(F.when(hit & (hour >= lo) & (hour < hi), 1)) / n)
        out[f"pct_weekend_{lab}"] = F.when(n > 0, F.count(F.when(hit & weekend, 1)) / n)
        per_hour = F.array(*[F.count(F.when(hit & (hour == h), 1)) for h in range(24)])
        out[f"peak_hour_{lab}"] = F.when(n > 0, F.array_position(per_hour, F.array_max(per_hour)) - 1)
    return out


def _static_columns(frame: EventFrame, cols) -> dict[str, Column]:
    kinds = {f.name: f.dataType for f in frame.events.schema.fields}
    usable = [c for c in cols or [] if c in kinds and c != frame.entity and not c.startswith("_")]
    texts = [c for c in usable if not isinstance(kinds[c], T.NumericType)]
    pairs: dict[str, list[str]] = {}
    if texts:
        # three distinct values already rule a column out, so the screen stays tiny
        screen = frame.events.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(texts)]).first()
        few = [c for i, c in enumerate(texts) if screen[i] <= 8]
        if few:
            found = frame.events.agg(*[F.sort_array(F.collect_set(col(c).cast("string"))).alias(f"v{i}") for i, c in enumerate(few)]).first()
            pairs = {c: list(found[i]) for i, c in enumerate(few) if len(found[i]) == 2}
    order = F.struct(*[col(c) for c in (frame.roles.order or ("_ts",))])
    out: dict[str, Column] = {}
    for c in usable:
        if isinstance(kinds[c], T.NumericType):
            out[safe_name(c)] = F.avg(col(c))
        elif c in pairs:
            larger = pairs[c][1]
            flag = F.coalesce((col(c).cast("string") == F.lit(larger)).cast("double"), F.lit(0.0))
            out[safe_name(f"{c}_{larger}")] = F.min_by(flag, order)
    return out


def overall_aggregate(frame: EventFrame, value_col: str, windows=(6, 12, "all")) -> tuple[DataFrame, list[str]]:
    return _entity_aggregate(frame, _overall_columns(frame, value_col, windows))


def temporal_patterns(frame: EventFrame, windows=("all",)) -> tuple[DataFrame, list[str]]:
    return _entity_aggregate(frame, _temporal_columns(frame, windows))


def static_attributes(frame: EventFrame, cols=None) -> tuple[DataFrame, list[str]]:
    return _entity_aggregate(frame, _static_columns(frame, cols or pick_static_columns(frame)))


def _entity_aggregate(frame: EventFrame, columns: dict[str, Column]) -> tuple[DataFrame, list[str]]:
    """One aggregate per entity.  Exact medians leave it when some entity is too large for one task."""
    key = col(frame.entity).alias(frame.entity)
    if not columns:
        return frame.events.select(key).distinct(), []
    order = list(columns)
    medians = [n for n in order if n in frame._medians]
    if medians and _has_hot_entity(frame):
        wide = frame.events.groupBy(key).agg(*[e.alias(n) for n, e in columns.items() if n not in medians])
        inputs = [F.when(frame.inside(w), col(v)).alias(f"_x_{n}") for n in medians for v, w in [frame._medians[n]]]
        found = group_medians(frame.events.select(key, *inputs), [frame.entity], {n: f"_x_{n}" for n in medians}, frame.hot_rows)
        return wide.join(found, frame.entity, "left").select(frame.entity, *order), order
    return frame.events.groupBy(key).agg(*[e.alias(n) for n, e in columns.items()]), order


def _has_hot_entity(frame: EventFrame) -> bool:
    largest = frame.events.groupBy(col(frame.entity)).count().agg(F.max("count")).first()[0]
    return (largest or 0) > frame.hot_rows


def pick_static_columns(frame: EventFrame) -> list[str]:
    """Strings with at most 20 values, and numbers that hardly vary within an entity."""
    events, roles = frame.events, frame.roles
    candidates = [c for c in events.columns if not c.startswith("_") and c != roles.entity]
    texts = [c for c in string_columns(events) if c in candidates]
    numbers = [
        f.name
        for f in events.schema.fields
        if f.name in candidates and isinstance(f.dataType, T.NumericType) and f.name != roles.amount
    ]
    picked = set()
    if texts:
        approx = events.agg(*[F.approx_count_distinct(col(c), 0.02).alias(f"d{i}") for i, c in enumerate(texts)]).first()
        near = [c for i, c in enumerate(texts) if approx[i] <= 40]
        if near:
            exact = events.agg(*[F.size(F.collect_set(col(c))).alias(f"d{i}") for i, c in enumerate(near)]).first()
            picked |= {c for i, c in enumerate(near) if exact[i] <= 20}
    if numbers:  # one pass over (entity, column, value): pairs per column, and the entities
        cells = [F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("v")) for i, c in enumerate(numbers)]
        marks = F.explode(F.array(F.struct(F.lit(-1).alias("c"), F.lit(0.0).alias("v")), *cells)).alias("s")
        pairs = events.select(col(roles.entity).alias("e"), marks).where("s.v IS NOT NULL").select("e", "s.c", "s.v").distinct()
        found = {r["c"]: r["n"] for r in pairs.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row per column
        picked |= {c for i, c in enumerate(numbers) if found.get(-1) and found.get(i, 0) / found[-1] < 2}
    return [c for c in candidates if c in picked]


def frequency_recency(frame: EventFrame, windows=(6, 12, "all")) -> tuple[DataFrame, list[str]]:
    """Recency, event counts, active months and mean gap between events.

    Gaps inside one calendar day are below 24 hours and floor to zero, so the
    table is first reduced to (entity, day, window segment): the order-dependent
    step then sees at most one row per active day, however busy the entity.
    """
    e = frame.entity
    flags = {label_of(w): frame.inside(w) for w in windows}
    day = F.to_date("_ts")
    segment = F.concat_ws("", *[F.when(h, "1").otherwise("0") for h in flags.values()])
    days = frame.events.groupBy(col(e).alias(e), day.alias("_day"), segment.alias("_segment")).agg(
        F.min("_ts").alias("_first"), F.max("_ts").alias("_last"), F.count("*").alias("_n")
    )
    ordered = Window.partitionBy(e).orderBy("_first")
    steps = days.withColumns(
        {
            "_prev": F.lag("_last").over(ordered),
            "_prev_month": F.lag(month_index(F.col("_last"))).over(ordered),
        }
    )
    gap = whole_days(F.col("_first"), F.col("_prev"))
    columns: dict[str, Column] = {"days_since_last": whole_days(F.lit(frame.latest).cast("timestamp_ntz"), F.max("_last"))}
    for w in windows:
        lab = label_of(w)
        now, before = frame.inside(w, F.col("_first")), F.coalesce(frame.inside(w, F.col("_prev")), F.lit(False))
        before = before & F.col("_prev").isNotNull()
        n = F.sum(F.when(now, F.col("_n")))
        new_month = ~before | (month_index(F.col("_first")) != F.col("_prev_month"))
        columns[f"event_count_{lab}"] = n
        columns[f"active_periods_{lab}"] = F.count(F.when(now & new_month, 1))
        columns[f"avg_gap_days_{lab}"] = F.when(n > 1, F.coalesce(F.sum(F.when(now & before, gap)), F.lit(0)) / (n - 1))
    return steps.groupBy(e).agg(*[x.alias(n) for n, x in columns.items()]), list(columns)


def entity_diversity(frame: EventFrame, cols_to_count=None, windows=(6, 12, "all")) -> tuple[DataFrame, list[str]]:
    """Distinct values per column and window, by one pass over (entity, value) pairs per column."""
    e = frame.entity
    requested = list(cols_to_count or [])
    columns = [c for c in requested if c in frame.events.columns]
    if not columns and not requested:
        texts = [c for c in string_columns(frame.events) if not c.startswith("_") and c != e]
        if texts:
            sizes = distinct_counts(frame.events, texts)
            columns = [c for c in texts if sizes[c] < 500]
    order = [f"n_unique_{safe_name(c)}_{label_of(w)}" for w in windows for c in columns]
    if not order:
        return frame.events.select(e).distinct(), []
    # all columns in one grouping of (entity, column, value); a value as text is distinct where the value is
    kinds = dict(frame.events.dtypes)
    texts = [(col(c) + F.lit(0.0) if kinds[c] in ("float", "double") else col(c)).cast("string") for c in columns]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), t.alias("v")) for i, t in enumerate(texts)])).alias("_cell")
    inside = [frame.inside(w).cast("int").alias(f"_in_{j}") for j, w in enumerate(windows)]
    flat = frame.events.select(col(e).alias(e), *inside, cells).where(F.col("_cell.v").isNotNull())
    seen = flat.groupBy(e, "_cell").agg(*[F.max(f"_in_{j}").alias(f"_in_{j}") for j in range(len(windows))])
    counted = [F.sum(F.when(F.col("_cell.c") == i, F.col(f"_in_{j}"))).alias(f"n_unique_{safe_name(c)}_{label_of(w)}") for j, w in enumerate(windows) for i, c in enumerate(columns)]
    return seen.groupBy(e).agg(*counted).select(e, *order), order


# ---------------------------------------------------------------------------
# gates on the finished matrix
# ---------------------------------------------------------------------------


def matrix_gate(features: DataFrame, entity: str, min_features: int = MIN_FEATURES) -> dict:
    """Too few features, or nothing but constants and flags, blocks the run."""
    names = [c for c in features.columns if c != entity]
    if len(names) < min_features:
        return {"blocked": True, "n_features": len(names), "reason": f"Only {len(names)} features built; need >= {min_features}."}
    ends = column_moments(features, names)
    # a third value strictly between the extremes proves more than two distinct values
    between = [((col(c) > F.lit(ends[c].low)) & (col(c) < F.lit(ends[c].high))).cast("int") for c in names]
    flags = features.select(F.array(*between).alias("f")).agg(*[F.max(F.element_at("f", i + 1)).alias(f"t{i}") for i in range(len(names))]).first()
    rich = sum(1 for i in range(len(names)) if flags[f"t{i}"])
    if rich == 0:
        return {"blocked": True, "n_features": len(names), "reason": "All features are binary or constant."}
    return {"blocked": False, "n_features": len(names), "n_multi_level": rich, "reason": ""}
