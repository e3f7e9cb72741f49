"""Outbox and dead-letter listings, pruning and retention."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.scalars import instant


def outbox_pending(outbox: DataFrame) -> DataFrame:
    return outbox.where(F.col("published_at").isNull())


def outbox_poll(outbox: DataFrame, n: int = S.OUTBOX_POLL_ROWS) -> DataFrame:
    """The ``n`` oldest pending rows."""
    return outbox_pending(outbox).orderBy("created_at", "id").limit(n).select("id", "task_id", "payload", "created_at")


def _published_before(outbox: DataFrame, as_of: str | datetime | Column, age_seconds: float) -> Column:
    age = F.make_dt_interval(secs=F.lit(int(age_seconds)).cast("decimal(18,6)"))
    return F.coalesce(F.col("published_at") < instant(outbox, "published_at", as_of) - age, F.lit(False))


def outbox_prunable(outbox: DataFrame, as_of: str | datetime | Column, age_seconds: float = S.OUTBOX_KEEP_SECONDS) -> DataFrame:
    return outbox.where(_published_before(outbox, as_of, age_seconds))


def outbox_prune(outbox: DataFrame, as_of: str | datetime | Column, age_seconds: float = S.OUTBOX_KEEP_SECONDS) -> DataFrame:
    """What stays: pending rows and rows published not longer ago than the age."""
    return outbox.where(~_published_before(outbox, as_of, age_seconds))


def mark_published(outbox: DataFrame, ids: DataFrame, as_of: str | datetime | Column) -> DataFrame:
    sent = ids.select("id").distinct().withColumn("_sent", F.lit(True))
    at = instant(outbox, "published_at", as_of)
    marked = F.when(F.col("_sent"), at).otherwise(F.col("published_at"))
    return outbox.join(sent, "id", "left").withColumn("published_at", marked).select(*outbox.columns)


def dlq_list(dlq: DataFrame) -> DataFrame:
    """All dead letters, newest first: a range-partitioned sort, no single task sees them all."""
    return dlq.orderBy(F.desc("dead_lettered_at"), F.asc("id"))


def monitor_sample(created: DataFrame, n: int = S.MONITOR_SAMPLE_ROWS) -> DataFrame:
    """First ``n`` in creation order."""
    return created.orderBy("index").limit(n)


def retain(df: DataFrame, ts: str, age_seconds: int | None, as_of: str | datetime | Column) -> DataFrame:
    """Rows not older than the age; None keeps everything."""
    if age_seconds is None:
        return df
    age = F.make_dt_interval(secs=F.lit(age_seconds).cast("decimal(18,6)"))
    return df.where(F.col(ts) >= instant(df, ts, as_of) - age)
