"""Which column is the entity, the time, the amount, the category: scored by name and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.columns import col, is_temporal
from cohortry.operators.features import Roles
from cohortry.operators.profiling import EXACT_DISTINCT_UP_TO, distinct_counts

# name fragments per role (fixed values); 100 points for an exact match, 50 for a contained one
ROLE_WORDS = {
    "entity": (
        "id", "entityid", "userid", "customerid", "clientid", "accountid", "subjectid", "patientid", "deviceid", "sensorid",
        "itemid", "productid", "orderid", "sessionid", "recordid", "uuid", "uid", "pid", "cardnumber", "ccnum",
    ),
    "timestamp": (
        "timestamp", "datetime", "date", "time", "ts", "createdat", "occurredat", "recordedat", "updatedat", "eventtime",
        "eventdate", "visitdate", "purchasedate", "orderdate", "transdate", "transdatetranstime",
    ),
    "amount": (
        "amount", "value", "price", "total", "amt", "cost", "revenue", "qty", "quantity", "score", "duration", "size",
        "weight", "measurement", "reading", "level",
    ),
    "category": (
        "category", "cat", "type", "kind", "label", "class", "group", "segment", "tag", "genre", "department", "sector",
        "channel", "mode", "eventtype", "itemtype", "producttype", "productcategory", "itemcategory", "subcategory",
        "transactiontype",
    ),
}
ACCEPT = {"entity": 80, "timestamp": 80, "amount": 50, "category": 40}
CANDIDATES_KEPT = 5


RATIO_STEPS = (0.50, 0.70, 0.90, 0.95)  # distinct ratios at which a score changes
SKETCH_ERROR = 0.01


def _distinct(df: DataFrame, names: list[str], exact: bool) -> dict[str, int]:
    """Distinct values per column: sketched, and counted exactly where the sketch could change a decision."""
    counts = distinct_counts(df, names)
    rows = max(df.count(), 1)
    for c in names:
        near = any(abs(counts[c] / rows - step) <= 5 * SKETCH_ERROR for step in RATIO_STEPS)
        if exact or (near and counts[c] > EXACT_DISTINCT_UP_TO):
            counts[c] = df.select(col(c)).where(col(c).isNotNull()).distinct().count()  # one column at a time: no row expansion
    return counts


def column_statistics(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: distinct values and ratio, type flags, extremes, parsable share of the first values."""
    fields = [f for f in df.schema.fields if not f.name.startswith("_") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    counts = _distinct(df, [f.name for f in fields], exact)
    parts = []
    for i, f in enumerate(fields):
        c = col(f.name)
        numeric = isinstance(f.dataType, T.NumericType)
        x = c.cast("double") if numeric else F.lit(None).cast("double")
        parts.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(i).alias("position"),
                F.lit(numeric).alias("numeric"),
                F.lit(isinstance(f.dataType, T.IntegralType)).alias("integer"),
                F.lit(is_temporal(f.dataType)).alias("temporal"),
                F.lit(isinstance(f.dataType, T.StringType)).alias("text"),
                F.lit(counts[f.name]).cast("long").alias("n_distinct"),
                F.min(x).alias("low"),
                F.max(x).alias("high"),
                F.count("*").alias("n_rows"),
            )
        )
    stats = df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    texts = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    share = {}
    if texts:  # the share of all values that parse
        parses = [F.avg(F.when(col(c).isNotNull(), col(c).try_cast("timestamp_ntz").isNotNull().cast("double"))).alias(f"p{i}") for i, c in enumerate(texts)]
        share = dict(zip(texts, df.agg(*parses).first()))
    parsable = F.lit(None).cast("double")
    for c, s in share.items():
        parsable = F.when(F.col("column") == c, F.lit(s)).otherwise(parsable)
    return stats.withColumns({"ratio": F.col("n_distinct") / F.greatest("n_rows", F.lit(1)), "parsable": parsable})


def _name_score(role: str):
    bare = F.regexp_replace(F.lower("column"), "[_-]", "")
    total = F.lit(0)
    for word in ROLE_WORDS[role]:
        total = total + F.when(bare == word, 100).when(F.contains(bare, F.lit(word)), 50).otherwise(0)
    return total


def role_scores(stats: DataFrame, entity: str | None = None, timestamp: str | None = None) -> DataFrame:
    """All (role, column, score) candidates with a positive score, ranked; the first five are kept."""
    ratio, n = F.col("ratio"), F.col("n_distinct")
    spread = F.when(ratio >= 0.90, 80).when(ratio >= 0.70, 40).when(ratio >= 0.50, 10).otherwise(0)
    entity_rows = stats.select(
        F.lit("entity").alias("role"), "column", "position", (_name_score("entity") + spread + F.when(F.col("integer"), 20).otherwise(0)).alias("score"), ratio.alias("tie")
    )
    looks_like_time = F.when(F.col("temporal"), 100).when(F.col("parsable") >= 0.8, 80).otherwise(0)
    time_rows = stats.select(
        F.lit("timestamp").alias("role"), "column", "position", (_name_score("timestamp") + looks_like_time).alias("score"), F.lit(0.0).alias("tie")
    )
    amounts = stats.where(F.col("numeric") & (ratio < 0.95) & (n > 2) & (F.col("column") != F.lit(entity or "")))
    shape = F.when(F.col("low") >= 0, 30).otherwise(0) + F.when(F.col("high") > F.col("low") * 10, 20).otherwise(0)
    amount_rows = amounts.select(
        F.lit("amount").alias("role"), "column", "position", (_name_score("amount") + shape).alias("score"), F.lit(0.0).alias("tie")
    )
    groups = stats.where(n.between(2, 100) & ~F.col("column").isin(entity or "", timestamp or ""))
    kind = F.when(F.col("text"), 30).otherwise(0) + F.when(n <= 50, 20).otherwise(0)
    category_rows = groups.select(
        F.lit("category").alias("role"), "column", "position", (_name_score("category") + kind).alias("score"), F.lit(0.0).alias("tie")
    )
    every = entity_rows.unionByName(time_rows).unionByName(amount_rows).unionByName(category_rows).where("score > 0")
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("score"), F.desc("tie"), "position"))
    return every.withColumn("place", place).where(F.col("place") <= CANDIDATES_KEPT).select("role", "place", "column", "score")


def resolve_roles(df: DataFrame, order: list[str], exact: bool = False, overrides: dict[str, str] | None = None) -> tuple[Roles, dict]:
    """Pick each role; ambiguous ones fall back to their best candidate and are reported."""
    measured = column_statistics(df, exact)
    stats = df.sparkSession.createDataFrame(measured.collect(), measured.schema)  # one row per column
    picked: dict[str, str | None] = {}
    ambiguous: dict[str, list[str]] = {}

    def settle(role: str, table: DataFrame):
        rows = table.where(F.col("role") == role).orderBy("place").collect()
        if not rows:
            picked[role] = None
            return
        picked[role] = rows[0]["column"]
        if rows[0]["score"] < ACCEPT[role]:
            ambiguous[role] = [r["column"] for r in rows]

    first = role_scores(stats)
    settle("entity", first)
    settle("timestamp", first)
    sure = {k: (None if k in ambiguous else picked[k]) for k in ("entity", "timestamp")}
    second = role_scores(stats, sure["entity"], sure["timestamp"])
    settle("amount", second)
    settle("category", second)
    for role, name in (overrides or {}).items():
        if name in df.columns:
            picked[role] = name
            ambiguous.pop(role, None)
    roles = Roles(picked["entity"] or "_row_id", picked["timestamp"], picked["amount"], picked["category"], tuple(order))
    return roles, ambiguous
