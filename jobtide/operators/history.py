"""What the append-only log says: current state, transitions, attempts, waiting and run times."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.scalars import is_terminal, seconds_between, seq_of
from jobtide.operators.sliced import SLICE_SECONDS, with_neighbour, with_running_sum


def log_order(history: DataFrame) -> list[Column]:
    """The one order of a task's rows: time, then the ordinal that its state change gave it, then the id. Rows without
    an ordinal, as foreign logs have them, come first in their instant."""
    return [F.col("occurred_at"), seq_of(history).alias("seq"), F.col("id")]


def _tied(history: DataFrame) -> DataFrame:
    """``history`` with what orders rows of one instant."""
    return history.withColumn("_tie", F.struct(*log_order(history)[1:]))


def latest(history: DataFrame) -> DataFrame:
    """Latest row per task as ``task_id, status, occurred_at, seq, id``. An aggregate, not a window: each map
    task sends one row per task id, so a task with very many rows costs no more than another."""
    last = F.max(F.struct(*log_order(history), "status")).alias("last")
    return history.groupBy("task_id").agg(last).select("task_id", "last.status", "last.occurred_at", "last.seq", "last.id")


def current_state(history: DataFrame) -> DataFrame:
    """Latest row per task as ``task_id, status, occurred_at, id``."""
    return latest(history).drop("seq")


def task_timeline(history: DataFrame) -> DataFrame:
    """Rows by task, then log order. Range partitioning on all columns may cut one task's rows apart."""
    return history.orderBy("task_id", *log_order(history))


def transitions(history: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``prev_status, prev_at, gap_seconds`` (NULL in the first row of a task)."""
    seen = with_neighbour(
        _tied(history),
        ["task_id"],
        "occurred_at",
        "_tie",
        {"prev_status": "status", "prev_at": "occurred_at"},
        slice_seconds=slice_seconds,
    )
    return seen.drop("_tie").withColumn("gap_seconds", seconds_between("prev_at", "occurred_at"))


def next_transitions(history: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``next_status, next_at, gap_seconds`` (NULL in the last row of a task)."""
    seen = with_neighbour(
        _tied(history),
        ["task_id"],
        "occurred_at",
        "_tie",
        {"next_status": "status", "next_at": "occurred_at"},
        forward=True,
        slice_seconds=slice_seconds,
    )
    return seen.drop("_tie").withColumn("gap_seconds", seconds_between("occurred_at", "next_at"))


def is_legal(previous: Column, status: Column) -> Column:
    pairs = [(previous == a) & (status == b) for a, b in S.LEGAL_TRANSITIONS]
    return reduce(lambda a, b: a | b, pairs)


def lifecycle_audit(history: DataFrame) -> DataFrame:
    """Rows whose step from the row before is not in the state diagram."""
    steps = transitions(history).withColumn("prev_status", F.coalesce("prev_status", F.lit(S.START)))
    return steps.where(~is_legal(F.col("prev_status"), F.col("status")))


def transition_matrix(history: DataFrame) -> DataFrame:
    """Counts of every ``(prev_status, status)`` pair with a flag for the legal ones."""
    steps = transitions(history).withColumn("prev_status", F.coalesce("prev_status", F.lit(S.START)))
    counted = steps.groupBy("prev_status", "status").agg(F.count("*").alias("n"))
    return counted.withColumn("legal", is_legal(F.col("prev_status"), F.col("status")))


def with_cycle(history: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``cycle``: how many terminal rows the task had before this row."""
    return with_running_sum(
        _tied(history),
        ["task_id"],
        "occurred_at",
        "_tie",
        is_terminal("status").cast("int"),
        "cycle",
        inclusive=False,
        slice_seconds=slice_seconds,
    ).drop("_tie")


def attempts(history: DataFrame, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Adds ``attempt``: how often the task was set running so far in its cycle, this row included."""
    return with_running_sum(
        _tied(with_cycle(history, slice_seconds)),
        ["task_id", "cycle"],
        "occurred_at",
        "_tie",
        (F.col("status") == S.RUNNING).cast("int"),
        "attempt",
        slice_seconds=slice_seconds,
    ).drop("_tie")


def queue_wait(history: DataFrame) -> DataFrame:
    """Seconds from a ``queued`` row to the ``running`` row right after it."""
    waits = transitions(history).where((F.col("prev_status") == S.QUEUED) & (F.col("status") == S.RUNNING))
    return waits.select("task_id", F.col("prev_at").alias("queued_at"), F.col("occurred_at").alias("started_at"), F.col("gap_seconds").alias("wait_seconds"))


def execution_duration(history: DataFrame) -> DataFrame:
    """Seconds from a ``running`` row to the row right after it, by what came of the run."""
    outcome = (
        F.when(F.col("status") == S.SUCCEEDED, S.SUCCEEDED)
        .when(F.col("status") == S.QUEUED, "retry")
        .when(F.col("status") == S.DEAD_LETTERED, S.DEAD_LETTERED)
    )
    runs = transitions(history).where(F.col("prev_status") == S.RUNNING).withColumn("outcome", outcome)
    return runs.where("outcome IS NOT NULL").select(
        "task_id", "outcome", F.col("prev_at").alias("started_at"), F.col("gap_seconds").alias("duration_seconds")
    )


def e2e_latency(history: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """First ``queued`` to first terminal row of every finished cycle, with the task type if ``tasks`` is given."""
    cycles = (
        with_cycle(history)
        .groupBy("task_id", "cycle")
        .agg(
            F.min(F.when(F.col("status") == S.QUEUED, F.col("occurred_at"))).alias("created_at"),
            F.min(F.when(is_terminal("status"), F.struct(*log_order(history), "status"))).alias("done"),
        )
        .where("created_at IS NOT NULL AND done IS NOT NULL")
    )
    rows = cycles.select(
        "task_id",
        "cycle",
        F.col("done.status").alias("status"),
        "created_at",
        F.col("done.occurred_at").alias("finished_at"),
        seconds_between("created_at", "done.occurred_at").alias("e2e_seconds"),
    )
    if tasks is None:
        return rows
    return rows.join(tasks.select(F.col("id").alias("task_id"), "type"), "task_id", "left")
