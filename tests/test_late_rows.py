"""Rows that come late, twice, or ahead of what they belong to."""

from datetime import timedelta

import pytest

from jobtide import schemas as S
from jobtide.streaming import jobs, timers
from jobtide.streaming.sinks import path_exists
from tests.test_streaming import T0, put, root, run, store, uid  # noqa: F401  (fixtures)

ROWS = "id string, task_id string, status string, occurred_at timestamp, seq long, retry_count int, max_retries int, timeout_seconds int, arrived_at timestamp"
FAILURES = "task_id string, failed_at timestamp, retry_count int, max_retries int, arrived_at timestamp"


def row(n, status, second, arrived=None, seq=1):
    at = T0 + timedelta(seconds=second)
    return (f"h{second}-{n}-{seq}", uid(n), status, at, seq, 0, 3, 30, at if arrived is None else T0 + timedelta(seconds=arrived))


def failure(n, second, retries, arrived=None):
    at = T0 + timedelta(seconds=second)
    return (uid(n), at, retries, 3, at if arrived is None else T0 + timedelta(seconds=arrived))


def stream(spark, root, schema, parts, job):
    for part in parts:
        put(spark, part, schema, f"{root}/in")
        source = spark.readStream.schema(schema).parquet(f"{root}/in")
        run(jobs.stream_to_files(job(source), f"{root}/out", f"{root}/cp"))
    return spark.read.parquet(f"{root}/out").collect()


def state(spark, root, name):
    return {r.key.task_id for r in spark.read.format("statestore").option("stateVarName", name).load(f"{root}/cp").collect()}


def test_a_late_result_counts_within_the_hold_back(spark, root):
    parts = [
        [row(1, "running", 0), row(2, "running", 0), row(9, "queued", 70)],
        [row(1, "succeeded", 20, arrived=75), row(9, "queued", 80)],
        [row(9, "queued", 500)],
        [row(8, "queued", 2000)],
    ]
    out = stream(spark, root, ROWS, parts, lambda s: timers.stream_reaper(s, "1 second", 60))
    assert {(r.task_id, r.outcome, r.due_at) for r in out} == {(uid(2), "requeued", T0 + timedelta(seconds=30))} and len(out) == 1
    # Nothing is left of tasks that are finished, waiting or reaped; only the newest row's task still has its hold-back.
    assert state(spark, root, "run") == {uid(8)}


def test_the_order_of_one_instant_decides(spark, root):
    parts = [[row(1, "succeeded", 5, seq=3), row(1, "running", 5, seq=2), row(2, "queued", 5, seq=2), row(2, "running", 5, seq=3)], [row(9, "queued", 500)]]
    out = stream(spark, root, ROWS, parts, lambda s: timers.stream_reaper(s, "1 second"))
    assert [r.task_id for r in out] == [uid(2)]


def test_a_run_delivered_again_is_reaped_once(spark, root):
    parts = [[row(1, "running", 0)], [row(9, "queued", 100)], [row(1, "running", 0, arrived=110), row(9, "queued", 120)], [row(9, "queued", 300)]]
    out = stream(spark, root, ROWS, parts, lambda s: timers.stream_reaper(s, "1 second", 60))
    assert [r.task_id for r in out] == [uid(1)]


def test_a_late_failure_is_retried_at_once_and_only_once(spark, root):
    parts = [
        [failure(1, 0, 0), failure(9, 600, 2)],
        [failure(2, 10, 1, arrived=601), failure(1, 0, 0, arrived=602)],
        [failure(8, 900, 0)],
        [failure(7, 2500, 0)],
    ]
    out = stream(spark, root, FAILURES, parts, lambda s: timers.stream_due_retries(s, "1 second", 400))
    assert sorted((r.task_id, r.retry_count, r.run_after) for r in out) == [
        (uid(1), 1, T0 + timedelta(seconds=5)),
        (uid(2), 2, T0 + timedelta(seconds=20)),
        (uid(8), 1, T0 + timedelta(seconds=905)),
        (uid(9), 3, T0 + timedelta(seconds=620)),
    ]
    # The first ones are forgotten; 8 was just given and 7 still waits.
    assert state(spark, root, "waiting") == {uid(7), uid(8)}


RESULTS = "id string, ok boolean, error string, known_type boolean"


@pytest.mark.parametrize("again", [False, True])
def test_results_ahead_of_their_task_wait_and_expire(spark, root, again):
    def tasks(*numbers):
        rows = [(uid(n), "x", "noop", {}, "running", 0, n % 2, 1, 30, None, T0, T0, T0) for n in numbers]
        return spark.createDataFrame(rows, S.TASK)

    def go(known, clock, *numbers):
        put(spark, [(uid(n), False, "boom", True) for n in numbers], RESULTS, f"{root}/in")
        source = spark.readStream.schema(RESULTS).parquet(f"{root}/in")
        run(jobs.stream_dlq(source, lambda: known, f"{root}/retry", f"{root}/dead", f"{root}/cp", lambda: clock))

    go(tasks(1), "2024-01-02 00:00:00", 1, 2, 3, 4)
    go(tasks(1, 2), "2024-01-02 00:10:00", 5)
    if again:  # a second batch without anything new for the parked ones
        go(tasks(1, 2), "2024-01-02 00:20:00", 6)
    go(tasks(3), "2024-01-02 01:00:00", 7)
    ids = lambda name, key="id": sorted(int(r[key][-12:]) for r in spark.read.parquet(f"{root}/{name}").collect())
    assert ids("retry") == [2] and ids("dead", "original_task_id") == [1, 3] and ids("dead_unmatched") == [4]
    last = 3 if again else 2
    assert ids(f"dead_parked/batch_id={last}") == ([5, 6, 7] if again else [5, 7])
    assert not path_exists(spark, f"{root}/dead_parked/batch_id={last - 2}")
