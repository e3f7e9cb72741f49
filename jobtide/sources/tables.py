"""Stored tables: tasks, history, dead letters and outbox as Parquet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.jsontext import decode_payload, encode_payload, is_object
from jobtide.functions.scalars import blank_to_null, event_month, instant, surrogate_id
from jobtide.streaming.sinks import drop_folder, move_folder, path_exists, subfolders


def decoded(df: DataFrame, strict: bool = True) -> DataFrame:
    """``payload`` from JSON text to a string map. Text that is no JSON object is an error unless lenient."""
    value = decode_payload("payload")
    if strict:
        broken = F.col("payload").isNotNull() & ~is_object("payload")
        problem = F.concat(F.lit("payload is not a JSON object, id "), F.col("id").cast("string"))
        value = F.when(broken, F.raise_error(problem).cast(S.PAYLOAD)).otherwise(value)
    return df.withColumn("payload", value)


def encoded(df: DataFrame) -> DataFrame:
    return df.withColumn("payload", encode_payload("payload"))


def read_tasks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return decoded(spark.read.schema(S.stored_as_text(S.STORED_TASK)).parquet(path), strict)


def read_dlq(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return decoded(spark.read.schema(S.stored_as_text(S.DEAD_LETTER)).parquet(path), strict)


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    """Outbox rows with the payload text and the same parsed by the schema it was written with."""
    rows = spark.read.schema(S.OUTBOX).parquet(path)
    return rows.withColumn("message", F.from_json("payload", S.OUTBOX_PAYLOAD))


def write_tasks(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A new version of the table. Rows are clustered by status, so status filters skip row groups."""
    encoded(df).repartitionByRange("status", "id").sortWithinPartitions("status", "id").write.mode(mode).parquet(path)


def write_dlq(df: DataFrame, path: str, mode: str = "append") -> None:
    encoded(df).write.mode(mode).parquet(path)


def in_range(df: DataFrame, start: str | datetime, end: str | datetime, ts: str = "occurred_at") -> Column:
    return (F.col(ts) >= instant(df, ts, start)) & (F.col(ts) < instant(df, ts, end))


def history_between(history: DataFrame, start: str | datetime, end: str | datetime) -> DataFrame:
    """Rows in ``[start, end)``. The month condition beside the time condition is what prunes directories; its
    months are those of the same instants, computed as for the rows, so bounds may have any form and zone."""
    months = F.col("event_month").between(*[event_month(instant(history, "occurred_at", t)) for t in (start, end)])
    return history.where(months & in_range(history, start, end))


def read_history(
    spark: SparkSession, path: str, start: str | datetime | None = None, end: str | datetime | None = None
) -> DataFrame:
    """Month-partitioned log; with a range, only the directories it touches are listed and read."""
    log = spark.read.schema(S.STORED_HISTORY).parquet(path)
    if start is not None and end is not None:
        log = history_between(log, start, end)
    return log.select(*S.LOG_COLUMNS)


def log_columns(log: DataFrame) -> DataFrame:
    """The columns of a log; a foreign one has no ordinals."""
    return log.select(*[c for c in S.LOG_COLUMNS if c in log.columns])


def with_month(history: DataFrame) -> DataFrame:
    return history.withColumn("event_month", event_month("occurred_at"))


def append_history(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append ``(task_id, status, occurred_at)`` and ``seq`` where there is one; the id is a digest of them when there is none."""
    if "id" not in events.columns:
        seq = ["seq"] if "seq" in events.columns else []
        events = events.withColumn("id", surrogate_id("task_id", "status", "occurred_at", *seq))
    monthly(log_columns(events)).write.mode(mode).partitionBy("event_month").parquet(path)


def monthly(history: DataFrame) -> DataFrame:
    """Rows gathered by month for writing. The rebalance hint lets the engine cut a month that holds
    most of the rows into many files and pack the small months together."""
    return with_month(history).hint("rebalance", "event_month")


def drop_history_before(spark: SparkSession, path: str, bound: str | datetime) -> None:
    """Retention of the monthly log: rows before ``bound`` leave the store. Whole months are dropped as folders; only the month
    that the bound cuts is read, and written anew beside itself before the old folder goes. A run that failed half way
    is finished by the next one, as the new folder is complete where it has its success mark."""
    edge = F.lit(str(bound)).cast("timestamp")
    cut = spark.range(1).select(event_month(edge)).first()[0]
    months = [name.removeprefix("event_month=") for name in subfolders(spark, path) if name.startswith("event_month=")]
    for month in months:
        if month < cut:
            drop_folder(spark, f"{path}/event_month={month}")
    old, new = f"{path}/event_month={cut}", f"{path}/_cut-{cut}"
    if not path_exists(spark, f"{new}/_SUCCESS"):
        if cut not in months:
            return
        rows = spark.read.schema(S.STORED_HISTORY).parquet(path).where((F.col("event_month") == cut) & (F.col("occurred_at") >= edge)).drop("event_month")
        rows.write.mode("overwrite").parquet(new)
    drop_folder(spark, old)
    move_folder(spark, new, old)


def repartition_history(spark: SparkSession, source: str, target: str) -> None:
    """One-off copy of an unpartitioned log into the monthly layout."""
    monthly(log_columns(spark.read.option("mergeSchema", True).parquet(source))).write.partitionBy("event_month").parquet(target)


def flatten_history(spark: SparkSession, source: str, target: str) -> None:
    """The way back: the monthly layout into one unpartitioned log."""
    log_columns(spark.read.option("mergeSchema", True).parquet(source)).write.parquet(target)


def outbox_rows(tasks: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    """One pending outbox row per task; the retry count is no part of the payload."""
    body = F.to_json(
        F.struct(
            F.col("id").cast("string").alias("task_id"),
            "name",
            "type",
            F.coalesce("payload", F.create_map().cast(S.PAYLOAD)).alias("payload"),
            "priority",
            "max_retries",
            "timeout_seconds",
            blank_to_null("idempotency_key").alias("idempotency_key"),
        )
    )
    at = instant(tasks, "created_at", as_of)
    return tasks.select(
        surrogate_id(F.lit("outbox"), "id", at).alias("id"),
        F.col("id").alias("task_id"),
        body.alias("payload"),
        at.alias("created_at"),
        F.lit(None).cast(tasks.schema["created_at"].dataType).alias("published_at"),
    )


def write_outbox(tasks: DataFrame, path: str, as_of: str | datetime | Column) -> None:
    outbox_rows(tasks, as_of).write.mode("append").parquet(path)

