"""The event log: appended as JSON files, read as a table, followed as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("iteration", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("issues", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.StringType()),
        T.StructField("recommendation", T.StringType()),
    ]
)
STARTS = ("run_started", "pipeline_started")  # event names (fixed values)
FINISH = "pipeline_complete"
IN_PRICE, OUT_PRICE = 3.0, 15.0  # per million tokens


def append_events(events: DataFrame, path: str) -> None:
    """One batch of events -> new JSON files; readers never see a half-written one."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; lines that are not JSON are skipped."""
    return spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def follow_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Replay what is there, then follow; the query's checkpoint remembers the position."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def _last(value: Column, when: Column, order: Column) -> Column:
    """The value of the last row (by ``order``) for which ``when`` holds."""
    return F.max_by(value, F.when(when, order))


def status_columns(order: Column) -> list[Column]:
    """Aggregates that fold a log into its status; the same in batch and stream."""
    event = F.col("event")
    start, finish = event.isin(*STARTS), event == FINISH
    begun, ended = F.max(F.when(start, order)), F.max(F.when(finish, order))
    open_run = begun.isNotNull() & (ended.isNull() | (begun > ended))
    return [
        open_run.alias("running"),
        _last(F.col("run_id"), start & F.col("run_id").isNotNull(), order).alias("run_id"),
        _last(F.col("agent"), (event == "agent_report") & F.col("agent").isNotNull(), order).alias("current_agent"),
        _last(F.col("iteration"), event == "iteration_started", order).alias("iteration"),
        _last(F.col("ts"), F.col("ts").isNotNull(), order).alias("last_event_ts"),
        F.when(~open_run, _last(F.col("seq"), finish, order)).alias("last_complete_seq"),
    ]


def status(events: DataFrame, by: str | None = None) -> DataFrame:
    """Snapshot of the log (of each ``by`` value): running, run, agent, iteration, last event, last completion."""
    keys = [F.col(by).alias("log")] if by else []
    return events.groupBy(*keys).agg(*status_columns(F.col("seq")))


def status_stream(events: DataFrame, path: str, checkpoint: str, by: str = "run_id", once: bool = True):
    """Keep the latest status per run in a folder of parquet files.

    Update mode hands each batch only the runs that changed; every batch
    writes its own folder, named by its id, so a replayed batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = status(events, by).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (query.trigger(availableNow=True) if once else query).start()


def latest_status(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per run of what :func:`status_stream` wrote."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")
    names = [c for c in rows.columns if c not in ("log", "batch")]
    newest = rows.groupBy("log").agg(F.max_by(F.struct(*names), "batch").alias("s"))
    return newest.select("log", "s.*")


# ---------------------------------------------------------------------------
# reports
# ---------------------------------------------------------------------------


def agent_reports(events: DataFrame, agent: str | None = None) -> DataFrame:
    reports = events.where("event = 'agent_report'")
    return reports if agent is None else reports.where(F.col("agent") == agent)


def last_reports(events: DataFrame) -> DataFrame:
    """The latest report of each agent."""
    fields = F.struct("seq", "iteration", "status", "issues", "metrics", "recommendation")
    return agent_reports(events).groupBy("agent").agg(F.max_by(fields, "seq").alias("r")).select("agent", "r.*")


def hard_blocks(events: DataFrame, by: str = "run_id") -> DataFrame:
    """Whether any report was blocked with the advice to escalate, per run."""
    hit = (F.col("status") == "blocked") & (F.col("recommendation") == "escalate")
    return agent_reports(events).groupBy(by).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("hard_block"))


def recent_summary(events: DataFrame, last: int = 20, by: str = "run_id") -> DataFrame:
    """The last N reports of each run in order, as one list of lines (N bounds the list)."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))
    line = F.concat_ws(
        " | ",
        F.concat(F.lit("[Iter "), F.coalesce(F.col("iteration").cast("string"), F.lit("?")), F.lit("] "), F.coalesce("agent", F.lit("?")), F.lit(" -> "), F.upper(F.coalesce("status", F.lit("?")))),
        F.when(F.size("issues") > 0, F.concat(F.lit("Issues: "), F.concat_ws("; ", "issues"))),
        F.when(F.col("recommendation").isNotNull(), F.concat(F.lit("Recommendation: "), F.col("recommendation"))),
    )
    recent = agent_reports(events).withColumn("_p", place).where(F.col("_p") <= last)
    return recent.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]).alias("lines"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, time, tokens, share of time and cost per agent, with a total row (agent is null)."""
    rolled = calls.rollup("agent").agg(
        F.grouping("agent").alias("is_total"),
        F.count("*").alias("calls"),
        F.sum("time_s").alias("time_s"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    whole = Window.partitionBy(F.lit(1))
    total = F.max(F.when(F.col("is_total") == 1, F.col("time_s"))).over(whole)
    cost = F.col("input_tokens") / 1e6 * IN_PRICE + F.col("output_tokens") / 1e6 * OUT_PRICE
    return rolled.withColumns({"time_share": F.col("time_s") / total, "cost": cost})
