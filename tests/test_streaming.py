"""Streams over several input files, restarted once from their checkpoint, against the batch result."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import schemas as S
from jobtide.operators import history as H
from jobtide.sources.tables import decoded
from jobtide.streaming import jobs, timers
from jobtide.streaming.sinks import shared_folder, use_rocksdb

T0 = datetime(2024, 1, 1)
ONE_FILE = {"availableNow": True}
MESSAGES = T.StructType([f for f in S.MESSAGE_ROW if f.name not in ("key", "headers")])


def uid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture(autouse=True)
def store(spark):
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture
def root(spark, tmp_path):
    return str(tmp_path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def event(n, status, minute, i=None):
    return (f"e{i if i is not None else minute}-{n}", uid(n), status, T0 + timedelta(minutes=minute))


def test_history_stream_keeps_every_row_once(spark, root):
    first = [event(1, "queued", 0), event(2, "queued", 1)]
    later = [event(1, "running", 2), event(2, "running", 60 * 24 * 40)]
    put(spark, first, S.TASK_HISTORY, f"{root}/in")

    def go():
        source = jobs.file_stream(spark, f"{root}/in", S.TASK_HISTORY, 1)
        run(jobs.stream_history(source, f"{root}/out", f"{root}/cp", ONE_FILE))

    go()
    put(spark, later, S.TASK_HISTORY, f"{root}/in")
    go()
    go()
    out = spark.read.parquet(f"{root}/out")
    assert out.count() == 4
    assert {r.event_month for r in out.select("event_month").distinct().collect()} == {"2024-01", "2024-02"}


def history_message(n, status, at, offset, raw=None):
    value = raw or json.dumps({"task_id": uid(n), "status": status, "at": at})
    return (bytearray(value, "utf8"), "task-history", 0, offset, T0)


def test_history_messages_bad_rows_to_quarantine_and_time_fallback(spark, root):
    rows = [
        history_message(1, "queued", "2024-01-01T00:00:05.123456789Z", 0),
        history_message(1, "running", "soon", 1),
        history_message(0, "", "", 2, "{not json"),
        history_message(0, "", "", 3, '{"task_id":"nope","status":"queued","at":"2024-01-01T00:00:00Z"}'),
    ]
    put(spark, rows, MESSAGES, f"{root}/in")
    source = jobs.file_stream(spark, f"{root}/in", MESSAGES)
    run(jobs.stream_history_messages(source, f"{root}/out", f"{root}/bad", f"{root}/cp"))
    good = {r.status: r.occurred_at for r in spark.read.parquet(f"{root}/out").collect()}
    assert good == {"queued": datetime(2024, 1, 1, 0, 0, 5, 123456), "running": T0}
    bad = {r.offset: r.reject_reason for r in spark.read.parquet(f"{root}/bad").collect()}
    assert bad == {2: "bad_json", 3: "bad_task_id"}


REQUESTS = T.StructType([T.StructField("id", T.StringType()), *S.REQUEST.fields])


def request(n, key):
    return (uid(n), f"job {n}", "noop", {"k": str(n)}, 0, 0, 0, key)


def test_request_stream_keys_stay_unique_over_batches_and_restarts(spark, root):
    target = jobs.RequestTables.under(f"{root}/db")

    def go():
        source = jobs.file_stream(spark, f"{root}/in", REQUESTS, 1)
        run(jobs.stream_requests(source, target, f"{root}/cp", lambda: "2024-01-01 00:00:00"))

    put(spark, [request(1, "a"), request(2, "a"), request(3, ""), request(4, "")], REQUESTS, f"{root}/in")
    go()
    put(spark, [request(5, "a"), request(6, "b"), request(7, None)], REQUESTS, f"{root}/in")
    go()
    made = {r.id for r in spark.read.parquet(target.tasks).collect()}
    assert made == {uid(n) for n in (1, 3, 4, 6, 7)}
    outcomes = {r.id: (r.outcome, r.task_id) for r in spark.read.parquet(target.outcomes).collect()}
    assert outcomes[uid(2)] == outcomes[uid(5)] == ("EXISTING", uid(1))
    assert spark.read.parquet(target.outbox).count() == spark.read.parquet(target.history).count() == 5
    # A batch that is run again changes nothing.
    before = sorted(map(str, spark.read.parquet(target.tasks).collect()))
    again = spark.createDataFrame([request(5, "a"), request(6, "b"), request(7, None)], REQUESTS)
    jobs.ingest_batch(again, 1, target, S.BUILTIN_TYPES, "2024-01-01 00:00:00", ["id"])
    assert sorted(map(str, spark.read.parquet(target.tasks).collect())) == before


@pytest.mark.parametrize("watermark", [None, "1 hour"])
def test_unique_requests_in_the_state_store(spark, root, watermark):
    schema = REQUESTS.add("sent_at", "timestamp") if "sent_at" not in REQUESTS.names else REQUESTS
    schema = T.StructType(schema.fields)
    rows = [(*request(n, key)[:8], T0 + timedelta(seconds=n)) for n, key in ((1, "a"), (2, "a"), (3, ""), (4, ""), (5, None))]
    put(spark, rows, schema, f"{root}/in")
    kept = jobs.unique_requests(jobs.file_stream(spark, f"{root}/in", schema), "sent_at", watermark)
    run(jobs.stream_to_files(kept, f"{root}/out", f"{root}/cp"))
    ids = {r.id for r in spark.read.parquet(f"{root}/out").collect()}
    assert {uid(3), uid(4), uid(5)} <= ids and len(ids) == 4


def test_outbox_stream_publishes_once_and_skips_broken_rows(spark, root):
    body = json.dumps({"task_id": uid(1), "name": "x", "type": "noop", "payload": {"a": "b"}, "priority": 1, "max_retries": 3, "timeout_seconds": 30})
    rows = [("o1", uid(1), body, T0, None), ("o2", uid(2), "{broken", T0, None), ("o3", uid(3), body, T0, T0)]
    put(spark, rows, S.OUTBOX, f"{root}/in")
    for _ in range(2):
        source = jobs.file_stream(spark, f"{root}/in", S.OUTBOX)
        run(jobs.stream_outbox(source, f"{root}/topic", f"{root}/done", f"{root}/bad", f"{root}/cp", lambda: "2024-01-02 00:00:00"))
    sent = [json.loads(bytes(r.value)) for r in spark.read.parquet(f"{root}/topic").collect()]
    assert [(m["task_id"], m["retry_count"], m["payload"]) for m in sent] == [(uid(1), 0, {"a": "b"})]
    assert {r.id for r in spark.read.parquet(f"{root}/done").collect()} == {"o1", "o2"}
    assert [r.id for r in spark.read.parquet(f"{root}/bad").collect()] == ["o2"]


def task_message(n, offset, raw=None):
    value = raw or json.dumps({"task_id": uid(n), "name": "x", "type": "noop", "payload": {}, "priority": 0, "max_retries": 3, "timeout_seconds": 30, "retry_count": 0})
    return (bytearray(value, "utf8"), "tasks", 1, offset, T0)


def test_redelivered_messages_of_finished_tasks_are_skipped(spark, root):
    put(spark, [task_message(1, 0), task_message(2, 1), task_message(9, 2), task_message(0, 3, "{not json")], MESSAGES, f"{root}/in")
    tasks = spark.createDataFrame([(uid(1), "succeeded"), (uid(2), "queued")], "id string, status string")
    source = jobs.file_stream(spark, f"{root}/in", MESSAGES)
    run(jobs.stream_messages(source, lambda: tasks, f"{root}/run", f"{root}/skip", f"{root}/bad", f"{root}/cp"))
    assert {r.task_id for r in spark.read.parquet(f"{root}/run").collect()} == {uid(2), uid(9)}
    assert [r.meta["offset"] for r in spark.read.parquet(f"{root}/skip").collect()] == ["0"]
    assert spark.read.parquet(f"{root}/bad").count() == 1


def test_current_state_stream_equals_batch_fold_with_files_out_of_order(spark, root):
    events = [event(n, s, 10 * n + m) for n in range(5) for m, s in enumerate(("queued", "running", "succeeded"))]
    for part in (events[7:], events[:7]):
        put(spark, part, S.TASK_HISTORY, f"{root}/in")
        source = jobs.file_stream(spark, f"{root}/in", S.TASK_HISTORY, 1)
        run(jobs.stream_current_state(source, f"{root}/out", f"{root}/cp"))
    streamed = {tuple(r) for r in jobs.current_from_changes(spark, f"{root}/out").collect()}
    batch = {tuple(r) for r in H.current_state(spark.createDataFrame(events, S.TASK_HISTORY)).collect()}
    assert streamed == batch


def test_closed_windows_have_the_batch_counts(spark, root):
    schema = "seen_at timestamp, kind string, latency double"
    rows = [(T0 + timedelta(seconds=7 * i), "a" if i % 3 else "b", float(i % 50)) for i in range(300)]
    for part in (rows[:120], rows[120:], [(T0 + timedelta(hours=2), "a", 1.0)]):
        put(spark, part, schema, f"{root}/in")
    parsed = spark.createDataFrame([], schema).schema
    source = jobs.file_stream(spark, f"{root}/in", parsed)
    run(jobs.stream_to_files(jobs.rates(source, "seen_at", ["kind"]), f"{root}/rates", f"{root}/cp1"))
    per_minute = {(r.window_start, r.kind): r.events for r in spark.read.parquet(f"{root}/rates").collect()}
    assert sum(per_minute.values()) == 300
    assert per_minute[(T0, "a")] == sum(1 for i in range(9) if i % 3)
    slid = jobs.sliding_quantiles(source, "seen_at", "latency", ["kind"], bounds=(10.0, 20.0, 40.0))
    run(jobs.stream_to_files(slid, f"{root}/p95", f"{root}/cp2"))
    out = spark.read.parquet(f"{root}/p95")
    assert out.agg(F.sum("total")).first()[0] == 300 * 5
    assert out.where("quantile > 40.0").count() == 0
    live = jobs.live_totals(source.withColumn("error", F.when(F.col("kind") == "b", "x")), "seen_at", 60)
    run(jobs.stream_to_files(live, f"{root}/live", f"{root}/cp3"))
    totals = spark.read.parquet(f"{root}/live").agg(F.sum("sent"), F.sum("err")).first()
    assert tuple(totals) == (300, 100)


def test_end_to_end_matches_and_leaves_open_tasks_with_null(spark, root):
    created = [(uid(n), T0 + timedelta(minutes=n)) for n in (1, 2, 3)] + [(uid(99), T0 + timedelta(days=3))]
    finished = [(uid(1), "succeeded", T0 + timedelta(minutes=31)), (uid(98), "failed", T0 + timedelta(days=3))]
    put(spark, created, "task_id string, created_at timestamp", f"{root}/c")
    put(spark, finished, "task_id string, status string, finished_at timestamp", f"{root}/f")
    c = spark.readStream.schema("task_id string, created_at timestamp").parquet(f"{root}/c")
    f = spark.readStream.schema("task_id string, status string, finished_at timestamp").parquet(f"{root}/f")
    run(jobs.stream_to_files(jobs.end_to_end(c, f), f"{root}/out", f"{root}/cp"))
    out = {r.task_id: (r.status, r.e2e_seconds) for r in spark.read.parquet(f"{root}/out").collect()}
    assert out[uid(1)] == ("succeeded", 1800.0)
    assert out[uid(2)] == out[uid(3)] == (None, None)


STATEFUL = "id string, task_id string, status string, occurred_at timestamp, retry_count int, max_retries int, timeout_seconds int"


def test_reaper_fires_only_for_runs_that_stay_silent(spark, root):
    def row(n, status, second, retries=0):
        return (f"h{second}-{n}", uid(n), status, T0 + timedelta(seconds=second), retries, 3, 30)

    schema = spark.createDataFrame([], STATEFUL).schema
    parts = [
        [row(1, "running", 0), row(2, "running", 0), row(3, "running", 0, retries=3)],
        [row(2, "succeeded", 20), row(4, "queued", 25)],
        [row(5, "queued", 600)],
        [row(6, "queued", 1200)],
    ]

    def go():
        source = jobs.file_stream(spark, f"{root}/in", schema, 1)
        run(jobs.stream_to_files(timers.stream_reaper(source, "1 second"), f"{root}/out", f"{root}/cp"))

    for part in parts[:2]:
        put(spark, part, STATEFUL, f"{root}/in")
        go()
    for part in parts[2:]:
        put(spark, part, STATEFUL, f"{root}/in")
    go()
    out = {r.task_id: (r.outcome, r.retry_count, r.due_at) for r in spark.read.parquet(f"{root}/out").collect()}
    due = T0 + timedelta(seconds=30)
    assert out == {uid(1): ("requeued", 1, due), uid(3): ("dead_lettered", 3, due)}


def test_retries_fall_due_after_their_delay(spark, root):
    schema = "task_id string, failed_at timestamp, retry_count int, max_retries int"
    parts = [
        [(uid(1), T0, 0, 3), (uid(2), T0, 6, 9), (uid(3), T0, 3, 3)],
        [(uid(9), T0 + timedelta(seconds=60), 0, 3)],
        [(uid(8), T0 + timedelta(seconds=90), 0, 3)],
    ]
    for part in parts:
        put(spark, part, schema, f"{root}/in")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        run(jobs.stream_to_files(timers.stream_due_retries(source, "1 second"), f"{root}/out", f"{root}/cp"))
    out = {r.task_id: (r.retry_count, r.run_after) for r in spark.read.parquet(f"{root}/out").collect()}
    assert out[uid(1)] == (1, T0 + timedelta(seconds=5))
    assert uid(2) not in out and uid(3) not in out


def test_results_are_split_into_retries_and_dead_letters(spark, root):
    rows = [(uid(n), "x", "noop", "{}", "running", 0, n, 2, 30, None, T0, T0, T0) for n in (1, 2, 3)]
    tasks = spark.createDataFrame(rows, S.stored_as_text(S.TASK))
    tasks = decoded(tasks)
    put(spark, [(uid(1), False, "boom", True), (uid(2), False, "bang", True), (uid(3), True, None, True)],
        "id string, ok boolean, error string, known_type boolean", f"{root}/in")
    source = spark.readStream.schema("id string, ok boolean, error string, known_type boolean").parquet(f"{root}/in")
    run(jobs.stream_dlq(source, lambda: tasks, f"{root}/retry", f"{root}/dead", f"{root}/cp", lambda: "2024-01-02 00:00:00"))
    retry = spark.read.parquet(f"{root}/retry").collect()
    assert [(r.id, r.retry_count, r.run_after) for r in retry] == [(uid(1), 2, datetime(2024, 1, 2, 0, 0, 10))]
    dead = spark.read.parquet(f"{root}/dead").collect()
    assert [(r.original_task_id, r.error_message, r.retry_count) for r in dead] == [(uid(2), "bang", 2)]


def test_expired_rows_do_not_pass(spark, root):
    put(spark, [event(1, "queued", 0), event(2, "queued", 60 * 48)], S.TASK_HISTORY, f"{root}/in")
    source = jobs.file_stream(spark, f"{root}/in", S.TASK_HISTORY)
    kept = jobs.drop_expired(source, "occurred_at", S.RETENTION_SECONDS["history"], "2024-01-03 12:00:00")
    run(jobs.stream_to_files(kept, f"{root}/out", f"{root}/cp"))
    assert [r.task_id for r in spark.read.parquet(f"{root}/out").collect()] == [uid(2)]


def test_shared_folder_follows_the_session_setting():
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://place/cp/"}

    assert shared_folder(Session).startswith("hdfs://place/cp/jobtide-")
