"""One lifecycle tick: claim what is due, reap what is stuck, say what happened."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.scalars import seq_of
from jobtide.operators.sets import append_deltas
from jobtide.operators.skew import settled, settling
from jobtide.operators.transitions import AsOf, TransitionResult, apply_transitions, claim, reap, route_outcomes
from jobtide.sources.buckets import BUCKETS, MOST_PARTS, BucketStore
from jobtide.sources.tables import decoded, encoded
from jobtide.streaming.sinks import write_batch


@dataclass(frozen=True)
class Tick:
    claimed: TransitionResult
    reaped: TransitionResult
    tasks_before: DataFrame
    delta: DataFrame
    tasks_after: DataFrame
    history: DataFrame


def lifecycle_tick(tasks: DataFrame, as_of: AsOf, k: int, workers: int = 1) -> Tick:
    """Claim and reap read the same snapshot and touch different rows (queued and running ones), so
    their deltas go into the table with one join."""
    claimed, reaped = claim(tasks, k, as_of, workers), reap(tasks, as_of)
    delta = append_deltas(claimed.tasks_delta, reaped.tasks_delta.drop("outcome"))
    log = append_deltas(claimed.history_delta, reaped.history_delta)
    return Tick(claimed, reaped, tasks, delta, apply_transitions(tasks, delta, unique=True), log)


def tick_summary(tick: Tick) -> DataFrame:
    """``outcome, n``: claimed, requeued and dead-lettered rows."""
    claimed = tick.claimed.tasks_delta.select(F.lit("claimed").alias("outcome"))
    moved = claimed.unionByName(tick.reaped.tasks_delta.select("outcome"))
    return moved.groupBy("outcome").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Store:
    """Folders of a task system on files: the tasks in buckets that take changed rows and are compacted one by one, the
    rest appended."""

    root: str
    buckets: int = BUCKETS
    most_parts: int = MOST_PARTS

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self) -> BucketStore:
        return BucketStore(self.path("tasks"), "id", ("seq", "updated_at"), self.buckets, self.most_parts)

    def tasks(self, spark: SparkSession, version: int) -> DataFrame:
        return decoded(self.table().read(spark, version, S.stored_as_text(S.STORED_TASK)))


def _stored(tasks: DataFrame) -> DataFrame:
    return encoded(tasks.select(*S.TASK_COLUMNS, seq_of(tasks).alias("seq")))


def save_tasks(tasks: DataFrame, store: Store, version: int) -> None:
    """A whole version. Rows are clustered by status inside their bucket, so a claim or a reap skips the row groups of
    finished tasks."""
    store.table().replace(_stored(tasks), version, ("status", "id"))


def save_changes(tasks: DataFrame, delta: DataFrame, store: Store, version: int) -> None:
    """The next version: only the changed rows are written, to the buckets of their ids. ``delta`` names each id once."""
    changed = apply_transitions(tasks.join(delta.select("id"), "id", "left_semi"), delta, unique=True)
    with settling():
        store.table().append(settled(_stored(changed)), version, ("status", "id"))


def run_tick(spark: SparkSession, store: Store, version: int, as_of: AsOf, k: int, workers: int = 1) -> None:
    """From version ``version - 1`` of the tasks to ``version``, with the history, dead letters and work
    that belong to it. There is one writer. All parts follow from the old snapshot and ``as_of``, with ids
    that do too, so a tick that failed half way is simply run again. The tasks are written last: where their version
    is there, the tick is complete."""
    tick = lifecycle_tick(store.tasks(spark, version - 1), as_of, k, workers)
    write_batch(tick.history, store.path("history"), version)
    write_batch(encoded(tick.reaped.dlq_delta), store.path("dlq"), version)
    write_batch(encoded(tick.claimed.dispatch_delta), store.path("claimed"), version)
    write_batch(tick.reaped.dispatch_delta, store.path("outbox"), version)
    save_changes(tick.tasks_before, tick.delta, store, version)


def run_results(spark: SparkSession, store: Store, version: int, results: DataFrame, as_of: AsOf) -> None:
    """The same for run results ``(id, ok, error, known_type)``: success, retry, dead letter or failure."""
    tasks = store.tasks(spark, version - 1)
    moved = route_outcomes(tasks, results, as_of)
    write_batch(moved.history_delta, store.path("history"), version)
    write_batch(encoded(moved.dlq_delta), store.path("dlq"), version)
    write_batch(moved.dispatch_delta, store.path("outbox"), version)
    save_changes(tasks, moved.tasks_delta.drop("outcome"), store, version)
