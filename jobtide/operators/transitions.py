"""Bulk state changes. Each returns deltas; nothing is written and no clock is read."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType
from pyspark.sql.window import Window

from jobtide import schemas as S
from jobtide.functions.jsontext import encode_payload
from jobtide.functions.scalars import backoff_seconds, can_retry, deadline, instant, plus_seconds, seq_of, surrogate_id
from jobtide.operators.ingest import history_rows
from jobtide.operators.sliced import with_place
from jobtide.sources.tables import outbox_rows

AsOf = str | datetime | Column

#: ``seq`` counts the changes of a task: it rises with every change, also between calls at one instant, and the
#: log row of a change carries it, so the fold of the log always ends where the table does.
CHANGED = ("status", "retry_count", "updated_at", "run_after", "seq")


@dataclass(frozen=True)
class TransitionResult:
    """What a state change adds or replaces; any part may be None when it does not apply."""

    tasks_delta: DataFrame
    history_delta: DataFrame | None = None
    dlq_delta: DataFrame | None = None
    dispatch_delta: DataFrame | None = None
    not_found: DataFrame | None = None
    dlq_after: DataFrame | None = None


def next_seq(tasks: DataFrame) -> Column:
    """Ordinal of the next change of a task."""
    return (seq_of(tasks) + 1).alias("seq")


def last_rows(delta: DataFrame) -> DataFrame:
    """One row per id: the latest by ``seq``, then by ``updated_at``; rows alike in both are told apart by their other
    values, so the choice never depends on where a row stood. Maps are compared as text."""
    columns = [c for c in delta.columns if c != "id"]
    if not columns:
        return delta.distinct()
    rest = [c for c in columns if c not in ("seq", "updated_at")]
    plain = [encode_payload(c).alias(c) if isinstance(delta.schema[c].dataType, MapType) else F.col(c) for c in rest]
    order = F.struct(seq_of(delta).alias("seq"), *[c for c in ("updated_at",) if c in columns], *plain)
    return delta.groupBy("id").agg(F.max_by(F.struct(*columns), order).alias("_row")).select("id", "_row.*")


def apply_transitions(tasks: DataFrame, delta: DataFrame, unique: bool = False) -> DataFrame:
    """``tasks`` with the rows of ``delta`` taking over its columns. An id that is given twice, as at-least-once
    delivery may do, counts once: the latest of its rows (``last_rows``). ``unique`` says that no id is, which spares
    an aggregation. A table without ``seq`` gets one when the delta brings it."""
    columns = [c for c in delta.columns if c != "id"]
    delta = delta if unique else last_rows(delta)
    if "seq" in columns and "seq" not in tasks.columns:
        tasks = tasks.withColumn("seq", seq_of(tasks))
    changed = delta.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = tasks.join(changed, "id", "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in tasks.columns
        ]
    )


def unmatched(delta: DataFrame, tasks: DataFrame) -> DataFrame:
    """Ids of ``delta`` that no task has."""
    return delta.select("id").distinct().join(tasks.select("id"), "id", "left_anti")


def accepted_updates(updates: DataFrame, order: str | None = None) -> DataFrame:
    """``id, status, place``: the updates that count, numbered from 1 per id in their ``order``. Updates of one id with the
    same order, repeated ones among them, are one: the greatest text. Without an order there is one per id."""
    if order is None:
        return updates.groupBy("id").agg(F.max("status").alias("status")).withColumn("place", F.lit(1).cast("bigint"))
    once = updates.groupBy("id", F.col(order).alias("_order")).agg(F.max("status").alias("status"))
    return with_place(once, "id", "_order", "place").drop("_order")


def claimable(tasks: DataFrame, as_of: AsOf) -> DataFrame:
    return tasks.where((F.col("status") == S.QUEUED) & (F.col("run_after") <= instant(tasks, "run_after", as_of)))


def claim_topk(tasks: DataFrame, k: int, as_of: AsOf) -> DataFrame:
    """The next ``k`` due tasks: highest priority, then oldest, then id."""
    return claimable(tasks, as_of).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id")).limit(k)


def assign_workers(claimed: DataFrame, workers: int) -> DataFrame:
    """Deals the ``k`` selected rows (and only those) to workers in claim order."""
    order = Window.orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))
    rank = F.row_number().over(order)
    return claimed.withColumn("claim_rank", rank).withColumn("worker", ((F.col("claim_rank") - 1) % workers).cast("int"))


def claim(tasks: DataFrame, k: int, as_of: AsOf, workers: int = 1) -> TransitionResult:
    """The next ``k`` tasks set running; ``dispatch_delta`` holds them with their ``worker``."""
    chosen = assign_workers(claim_topk(tasks, k, as_of), workers)
    at = instant(tasks, "updated_at", as_of)
    moved = chosen.withColumns({"status": F.lit(S.RUNNING), "updated_at": at, "seq": next_seq(chosen)})
    return TransitionResult(
        tasks_delta=moved.select("id", *CHANGED),
        history_delta=history_rows(moved, S.RUNNING, at),
        dispatch_delta=moved,
    )


def set_status(
    tasks: DataFrame, updates: DataFrame, as_of: AsOf, with_history: bool = True, order: str | None = None
) -> TransitionResult:
    """Any text is taken as a status and the old status is not looked at. The updates of one id take effect one after the
    other in their ``order``: each accepted one has its log row, and the last one stays in the table."""
    at = instant(tasks, "updated_at", as_of)
    old = tasks.select("id", seq_of(tasks).alias("_seq"))
    done = accepted_updates(updates, order).join(old, "id")
    done = done.withColumn("seq", F.col("_seq") + F.col("place")).select("id", "status", "seq")
    last = done.groupBy("id").agg(F.max(F.struct("seq", "status")).alias("r"))
    delta = last.select("id", "r.status", at.alias("updated_at"), "r.seq")
    log = history_rows(done, F.col("status"), at) if with_history else None
    return TransitionResult(delta, log, not_found=unmatched(updates, tasks))


def _requeued(rows: DataFrame, as_of: AsOf, run_after: Column) -> DataFrame:
    return rows.withColumns(
        {
            "run_after": run_after,
            "status": F.lit(S.QUEUED),
            "retry_count": F.col("retry_count") + 1,
            "updated_at": instant(rows, "updated_at", as_of),
            "seq": next_seq(rows),
        }
    )


def requeue_rows(rows: DataFrame, as_of: AsOf) -> DataFrame:
    """Whole task rows back to the queue; the delay comes from the old retry count."""
    later = plus_seconds(instant(rows, "run_after", as_of), backoff_seconds("retry_count"))
    return _requeued(rows, as_of, later)


def requeue(tasks: DataFrame, ids: DataFrame, as_of: AsOf, with_history: bool = True) -> TransitionResult:
    moved = requeue_rows(tasks.join(ids.select("id"), "id", "left_semi"), as_of)
    at = instant(moved, "updated_at", as_of)
    return TransitionResult(
        moved.select("id", *CHANGED),
        history_rows(moved, S.QUEUED, at) if with_history else None,
        dispatch_delta=outbox_rows(moved, as_of),
        not_found=unmatched(ids, tasks),
    )


def dlq_rows(tasks: DataFrame, error: Column, as_of: AsOf) -> DataFrame:
    """Dead-letter copies of whole task rows."""
    at = instant(tasks, "updated_at", as_of)
    return tasks.select(
        surrogate_id(F.lit("dlq"), "id", at).alias("id"),
        F.col("id").alias("original_task_id"),
        "name",
        "type",
        "payload",
        "priority",
        "retry_count",
        "max_retries",
        "timeout_seconds",
        F.coalesce(error, F.lit("")).alias("error_message"),
        F.col("created_at").alias("original_created_at"),
        at.alias("dead_lettered_at"),
    )


def dlq_snapshot(failures: DataFrame, tasks: DataFrame, as_of: AsOf) -> tuple[DataFrame, DataFrame]:
    """``(dead-letter rows, ids without a task)`` for failures ``(id, error_message)``."""
    once = failures.groupBy("id").agg(F.min("error_message").alias("_error"))
    rows = tasks.join(once, "id", "inner")
    return dlq_rows(rows, F.col("_error"), as_of), unmatched(failures, tasks)


def dead_letter(tasks: DataFrame, failures: DataFrame, as_of: AsOf, with_history: bool = True) -> TransitionResult:
    snapshot, missing = dlq_snapshot(failures, tasks, as_of)
    at = instant(tasks, "updated_at", as_of)
    moved = tasks.join(failures.select("id"), "id", "left_semi").withColumn("seq", next_seq(tasks))
    return TransitionResult(
        moved.select("id", F.lit(S.DEAD_LETTERED).alias("status"), at.alias("updated_at"), "seq"),
        history_rows(moved, S.DEAD_LETTERED, at) if with_history else None,
        dlq_delta=snapshot,
        not_found=missing,
    )


def stale(tasks: DataFrame, as_of: AsOf) -> DataFrame:
    return tasks.where((F.col("status") == S.RUNNING) & (deadline() < instant(tasks, "updated_at", as_of)))


def reap_plan(tasks: DataFrame, as_of: AsOf) -> DataFrame:
    """Stuck rows with their ``outcome``: ``requeued`` or ``dead_lettered``."""
    return stale(tasks, as_of).withColumn("outcome", F.when(can_retry(), "requeued").otherwise(S.DEAD_LETTERED))


def reap(tasks: DataFrame, as_of: AsOf) -> TransitionResult:
    """Requeue without delay while retries are left, else dead-letter. Both sides only touch rows that
    are still running, because both come from the same filter."""
    plan = reap_plan(tasks, as_of)
    at = instant(tasks, "updated_at", as_of)
    again = F.col("outcome") == "requeued"
    moved = plan.withColumns(
        {
            "status": F.when(again, S.QUEUED).otherwise(S.DEAD_LETTERED),
            "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "run_after": F.when(again, instant(tasks, "run_after", as_of)).otherwise(F.col("run_after")),
            "updated_at": at,
            "seq": next_seq(tasks),
        }
    )
    return TransitionResult(
        moved.select("id", *CHANGED, "outcome"),
        history_rows(moved, F.col("status"), at),
        dlq_delta=dlq_rows(moved.where(~again), F.lit(S.REAPED_MESSAGE), as_of),
        dispatch_delta=outbox_rows(moved.where(again), as_of),
    )


def dlq_retry(dlq: DataFrame, tasks: DataFrame, dlq_ids: DataFrame, as_of: AsOf) -> TransitionResult:
    """Dead letters back to the queue with a fresh retry budget; their rows leave the dead-letter table."""
    at = instant(tasks, "updated_at", as_of)
    chosen = dlq.join(dlq_ids.select("id"), "id", "left_semi")
    targets = chosen.select(F.col("id").alias("dlq_id"), F.col("original_task_id").alias("id"))
    owners = tasks.join(targets.select("id").distinct(), "id", "left_semi")
    moved = owners.withColumns(
        {
            "status": F.lit(S.QUEUED),
            "retry_count": F.lit(0),
            "updated_at": at,
            "run_after": instant(tasks, "run_after", as_of),
            "seq": next_seq(tasks),
        }
    )
    served = targets.join(tasks.select("id"), "id", "left_semi").select(F.col("dlq_id").alias("id"))
    return TransitionResult(
        moved.select("id", *CHANGED),
        history_rows(moved, S.QUEUED, at),
        dispatch_delta=outbox_rows(moved, as_of),
        not_found=dlq_ids.select("id").join(served, "id", "left_anti"),
        dlq_after=dlq.join(served, "id", "left_anti"),
    )


def failure_route(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Task rows joined to results ``(id, ok, error, known_type)`` with the ``outcome`` of each:
    ``succeeded``, ``retry``, ``dead_lettered`` or ``failed`` (no handler for the type). Results may come more than
    once: a success wins, then the least error."""
    first = F.min(F.struct((~F.col("ok")).alias("bad"), "ok", "error", "known_type")).alias("r")
    results = results.groupBy("id").agg(first).select("id", "r.ok", "r.error", "r.known_type")
    outcome = (
        F.when(~F.col("known_type"), S.FAILED)
        .when(F.col("ok"), S.SUCCEEDED)
        .when(can_retry(), "retry")
        .otherwise(S.DEAD_LETTERED)
    )
    return tasks.join(results.select("id", "ok", "error", "known_type"), "id", "inner").withColumn("outcome", outcome)


def route_outcomes(tasks: DataFrame, results: DataFrame, as_of: AsOf) -> TransitionResult:
    """All outcomes in one pass: the outcome is computed once per row and every delta reads it."""
    routed = failure_route(tasks, results)
    at = instant(tasks, "updated_at", as_of)
    again = F.col("outcome") == "retry"
    later = plus_seconds(instant(tasks, "run_after", as_of), backoff_seconds("retry_count"))
    moved = routed.withColumn("run_after", F.when(again, later).otherwise(F.col("run_after"))).withColumns(
        {
            "status": F.when(again, S.QUEUED).otherwise(F.col("outcome")),
            "retry_count": F.when(again, F.col("retry_count") + 1).otherwise(F.col("retry_count")),
            "updated_at": at,
            "seq": next_seq(tasks),
        }
    )
    return TransitionResult(
        moved.select("id", *CHANGED, "outcome"),
        history_rows(moved, F.col("status"), at),
        dlq_delta=dlq_rows(moved.where(F.col("outcome") == S.DEAD_LETTERED), F.col("error"), as_of),
        dispatch_delta=outbox_rows(moved.where(again), as_of),
        not_found=unmatched(results, tasks),
    )
