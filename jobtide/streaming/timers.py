"""Keyed state with event-time timers: stuck runs and retries that fall due.

The watermark lies on the time a row arrived, event times are data: a row that comes late is late news, not a row to
drop. Deadlines wait another ``hold_back``, the longest that news of an event may take, before they count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobtide.functions.scalars import backoff_seconds, micros, seq_of
from jobtide.schemas import DEAD_LETTERED, REAPED_MESSAGE, RUNNING
from jobtide.streaming.sinks import use_rocksdb

# Times cross into Python as whole microseconds, so no time zone is involved there.
_RUN = "status string, at_us bigint, seq bigint, id string, retry_count int, max_retries int, timeout_seconds int"
_REAPED = "task_id string, outcome string, retry_count int, error_message string, due_us bigint"
_DUE = "task_id string, retry_count int, due_us bigint"
_GIVEN = "given"


def _timer(at_us: int) -> int:
    """The first millisecond after a moment."""
    return at_us // 1000 + 1


def _wait(handle: StatefulProcessorHandle, at_us: int, before: Iterable[int] = ()) -> None:
    """One timer per task: those in ``before`` go. A list of timers is a search in the state store that stays open until
    the task ends, so it is asked for only where the stored row does not tell the timer."""
    for timer in before:
        handle.deleteTimer(timer)
    handle.registerTimer(_timer(at_us))


class StuckRuns(StatefulProcessor):
    """Keeps the newest row of a task; while that is a running one, a timer waits at its deadline. The state of any other
    row, and of a run that was reaped, goes once no older news of the task can come any more."""

    def __init__(self, hold_us: int = 0):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.run.get()
        newest = stored = None if found is None else tuple(found)
        for row in rows:
            found = (row.status, row.at_us, row.seq, row.id, row.retry_count, row.max_retries, row.timeout_seconds)
            if newest is None or found[1:4] > newest[1:4]:
                newest = found
        if newest != stored:
            self.run.update(newest)
            if stored is None:
                before = ()
            else:
                before = self.handle.listTimers() if stored[0] == _GIVEN else [_timer(self._until(stored))]
            _wait(self.handle, self._until(newest), before)
        return iter(())

    def _until(self, run: tuple) -> int:
        """A task is stuck only after its deadline."""
        return (_deadline_us(run) if run[0] == RUNNING else run[1]) + self.hold_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        run = tuple(self.run.get())
        if run[0] != RUNNING:
            self.run.clear()
            return
        retries, limit = run[4], run[5]
        if retries < limit:
            outcome, retries, error = "requeued", retries + 1, None
        else:
            outcome, error = DEAD_LETTERED, REAPED_MESSAGE
        # The run stays known as reaped as long as its rows may be delivered once more.
        self.run.update((_GIVEN, *run[1:]))
        _wait(self.handle, max(_deadline_us(run), timerValues.getCurrentWatermarkInMs() * 1000) + self.hold_us)
        yield Row(task_id=key[0], outcome=outcome, retry_count=retries, error_message=error, due_us=_deadline_us(run))

    def close(self) -> None:
        pass


def _deadline_us(run: tuple) -> int:
    return run[1] + run[6] * 1_000_000


def _arrival(rows: DataFrame, event_time: str) -> Column:
    """When a row arrived; of a log that does not say so, when it happened."""
    return F.col("arrived_at" if "arrived_at" in rows.columns else event_time).alias("arrived_at")


def stream_reaper(history: DataFrame, delay: str = "30 seconds", hold_back_seconds: float = 0) -> DataFrame:
    """Stuck runs of a history stream that also carries ``retry_count, max_retries, timeout_seconds``, and ``arrived_at`` where
    rows may arrive late.

    A task is reaped when the watermark of the arrivals passes its deadline plus ``hold_back_seconds`` and nothing newer is
    known of it: a result that arrives within the hold-back counts by the time it happened. ``delay`` is how far arrivals
    themselves may be out of order. State is cleared for finished tasks, also after the hold-back. An idle stream does not
    move the watermark: feed it heartbeat rows if deadlines must fire without traffic.
    """
    use_rocksdb(history.sparkSession)
    rows = history.select(
        F.col("task_id").cast("string").alias("task_id"),
        F.col("id").cast("string").alias("id"),
        "status",
        micros("occurred_at").alias("at_us"),
        seq_of(history).alias("seq"),
        "retry_count",
        "max_retries",
        "timeout_seconds",
        _arrival(history, "occurred_at"),
    ).withWatermark("arrived_at", delay)
    fired = rows.groupBy("task_id").transformWithState(
        statefulProcessor=StuckRuns(int(hold_back_seconds * 1_000_000)), outputStructType=_REAPED, outputMode="Append", timeMode="EventTime"
    )
    return fired.withColumn("due_at", F.timestamp_micros("due_us")).drop("due_us")


class DueRetries(StatefulProcessor):
    """One waiting retry per task, given out when its time has come. A given one stays known for the hold-back, so a
    failure that is delivered twice is retried once; then its state goes."""

    def __init__(self, hold_us: int = 0):
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "failed_us bigint, retry_count int, due_us bigint, given boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.waiting.get()
        newest = stored = None if found is None else tuple(found)
        for row in rows:
            found = (row.failed_us, row.retry_count, row.due_us, False)
            newest = found if newest is None or found[:2] > newest[:2] else newest
        if newest != stored:
            self.waiting.update(newest)
            if stored is None:
                before = ()
            else:
                before = self.handle.listTimers() if stored[3] else [_timer(stored[2] - 1000)]
            # Due at its moment, not after it; one that is overdue already fires with this batch.
            _wait(self.handle, newest[2] - 1000, before)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failed_us, retry_count, due_us, given = tuple(self.waiting.get())
        if given or not self.hold_us:
            self.waiting.clear()
        else:
            self.waiting.update((failed_us, retry_count, due_us, True))
            _wait(self.handle, max(due_us, timerValues.getCurrentWatermarkInMs() * 1000) + self.hold_us)
        if not given:
            yield Row(task_id=key[0], retry_count=retry_count, due_us=due_us)

    def close(self) -> None:
        pass


def stream_due_retries(failures: DataFrame, delay: str = "10 seconds", hold_back_seconds: float = 0) -> DataFrame:
    """Dispatch rows for failed runs ``(task_id, failed_at, retry_count, max_retries)``, and ``arrived_at`` where rows may arrive
    late, once their delay is over. A failure whose row comes after that is given out at once."""
    use_rocksdb(failures.sparkSession)
    wait_us = backoff_seconds("retry_count").cast("bigint") * F.lit(1_000_000)
    rows = (
        failures.where("retry_count < max_retries")
        .select(
            F.col("task_id").cast("string").alias("task_id"),
            micros("failed_at").alias("failed_us"),
            (F.col("retry_count") + 1).alias("retry_count"),
            (micros("failed_at") + wait_us).alias("due_us"),
            _arrival(failures, "failed_at"),
        )
        .withWatermark("arrived_at", delay)
    )
    due = rows.groupBy("task_id").transformWithState(
        statefulProcessor=DueRetries(int(hold_back_seconds * 1_000_000)), outputStructType=_DUE, outputMode="Append", timeMode="EventTime"
    )
    return due.withColumn("run_after", F.timestamp_micros("due_us")).drop("due_us")
