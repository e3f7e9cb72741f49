"""Bulk key lookups, existence checks and integrity audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions.scalars import is_terminal


def lookup_tasks(tasks: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """One row per asked id, with ``found`` and the columns of the task (NULL when there is none)."""
    hit = tasks.withColumn("_hit", F.lit(True))
    return ids.select(id).join(hit, id, "left").withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def lookup_dlq(dlq: DataFrame, ids: DataFrame) -> DataFrame:
    return lookup_tasks(dlq, ids)


def with_terminal_flag(messages: DataFrame, tasks: DataFrame, id: str = "task_id") -> DataFrame:
    """Adds ``skip``: the task exists and is finished. The status filter runs before the join, so only
    finished ids take part; a task that is not known is not skipped."""
    done = tasks.where(is_terminal("status")).select(F.col("id").alias(id), F.lit(True).alias("_done"))
    return messages.join(done, id, "left").withColumn("skip", F.col("_done").isNotNull()).drop("_done")


def skip_terminal(messages: DataFrame, tasks: DataFrame, id: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """``(to_run, skipped)``."""
    done = tasks.where(is_terminal("status")).select(F.col("id").alias(id))
    return messages.join(done, id, "left_anti"), messages.join(done, id, "left_semi")


def skipped_count(flagged: DataFrame) -> DataFrame:
    return flagged.agg(F.count_if("skip").alias("skipped"), F.count("*").alias("delivered"))


def history_for(history: DataFrame, tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows ``(task_id, task_exists, history columns)``. A task without history has one row with NULLs;
    so has an id without a task, told apart by ``task_exists``. History of unknown tasks is not shown.

    Only rows of asked tasks leave the log. It is the large side of an inner join, which Spark broadcasts into
    or splits where one task holds much of it, by the sizes it meets.
    """
    asked = lookup_tasks(tasks.select("id"), ids).select(F.col("id").alias("task_id"), F.col("found").alias("task_exists")).distinct()
    shown = history.join(asked.where("task_exists"), "task_id")
    present = history.join(asked.where("task_exists"), "task_id", "left_semi").select("task_id").distinct()
    blank = asked.join(present, "task_id", "left_anti")
    columns = ["task_id", "task_exists", *[c for c in history.columns if c != "task_id"]]
    return shown.select(*columns).unionByName(blank, allowMissingColumns=True)


def orphan_history(history: DataFrame, tasks: DataFrame) -> DataFrame:
    return history.join(tasks.select(F.col("id").alias("task_id")), "task_id", "left_anti")


def orphan_dlq(dlq: DataFrame, tasks: DataFrame) -> DataFrame:
    return dlq.join(tasks.select(F.col("id").alias("original_task_id")), "original_task_id", "left_anti")
