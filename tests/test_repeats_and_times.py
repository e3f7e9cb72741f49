"""Times in any form and zone, and rows that at-least-once delivery brings more than once."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from jobtide.functions import scalars as X
from jobtide.operators import dispatch, metrics, transitions
from jobtide.sources import messages, tables
from jobtide.streaming import sinks
from tests.test_lifecycle import NOW, table, task  # noqa: F401  (a fixture)


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


def instants(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "task_id int, t string").select(F.col("task_id").cast("string"), F.lit("queued").alias("status"), F.col("t").cast("timestamp").alias("occurred_at"))


BOUNDS = [
    ("2024-01-31 23:30:00-05:00", ["2024-01-31T20:00:00Z", "2024-02-01T04:00:00Z"]),
    ("2024-2-1 00:00:00", ["2024-01-31T20:00:00Z"]),
    (datetime(2024, 2, 1, 6, tzinfo=timezone(timedelta(hours=1))), ["2024-01-31T20:00:00Z", "2024-02-01T04:00:00Z"]),
]


@pytest.mark.parametrize("end,inside", BOUNDS)
@pytest.mark.parametrize("start", ["2024-1-1 00:00:00", "2024-01-01T00:00:00Z"])
def test_ranges_lose_no_row_whatever_the_bounds_look_like(spark, tmp_path, start, end, inside):
    log = instants(spark, "2023-12-31T23:59:59Z", "2024-01-31T20:00:00Z", "2024-02-01T04:00:00Z", "2024-03-01T00:00:00Z")
    tables.append_history(log, str(tmp_path / "log"))
    got = tables.read_history(spark, str(tmp_path / "log"), start, end)
    want = instants(spark, *inside)
    assert sorted(r.occurred_at for r in got.collect()) == sorted(r.occurred_at for r in want.collect())


def test_ids_and_months_are_the_same_in_every_session_zone(spark, zone):
    moment = spark.createDataFrame([(1706752799500000,), (1710038400000000,)], "m long")
    seen = set()
    for name in ("UTC", "America/New_York", "Asia/Kolkata"):
        zone(name)
        rows = moment.select(F.timestamp_micros("m").alias("t")).select(X.surrogate_id(F.lit("a"), "t").alias("id"), X.event_month("t").alias("month"))
        seen.add(tuple((r.id, r.month) for r in rows.collect()))
    assert len(seen) == 1
    assert [m for _, m in seen.pop()] == ["2024-02", "2024-03"]


@pytest.mark.parametrize("text", ["12:30:00", "T12:30", "2024", "2024-01-01", "2024-01-01T00:00:00", "2024-1-1T0:0:0Z", "2024-13-01T00:00:00Z", "2024-01-01 00:00:00Z"])
def test_other_times_are_replaced_by_the_arrival(spark, text):
    arrival = datetime(2024, 5, 5, 5)
    row = (None, bytearray(f'{{"task_id":"{"0" * 8}-0000-0000-0000-{"0" * 12}","status":"queued","at":"{text}"}}'.encode()), "t", 0, 0, arrival)
    df = spark.createDataFrame([row], "key binary, value binary, topic string, partition int, offset long, timestamp timestamp")
    good, _ = messages.parse_history_messages(df)
    assert [r.occurred_at for r in good.collect()] == [arrival]


def test_text_behind_a_message_is_refused(spark):
    body = f'{{"task_id":"{"0" * 8}-0000-0000-0000-{"0" * 12}","name":"n","type":"t"}}'
    rows = [(None, bytearray((body + tail).encode()), "t", 0, i, NOW, None) for i, tail in enumerate(["", " ", " junk", body, "}", ","])]
    df = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long, timestamp timestamp, headers array<struct<key:string,value:binary>>")
    good, bad = messages.parse_task_messages(df)
    assert good.count() == 2
    assert {r.offset for r in bad.where("reject_reason = 'bad_json'").collect()} == {2, 3, 4, 5}


def test_quoted_type_names(spark):
    df = spark.createDataFrame([('a"b\\c\n\x01é',), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(X.quoted("t")).collect()] == ['"a\\"b\\\\c\\n\\x01é"', '"plain"', None]


def test_repeated_results_change_a_task_once(spark, table):  # noqa: F811
    tasks = table(*[task(n, "running") for n in range(4)])
    ids = [r.id for r in tasks.select("id").orderBy("id").collect()]
    results = [(ids[0], True, None, True), (ids[0], True, None, True), (ids[1], False, "x", True), (ids[1], False, "x", True), (ids[2], False, "y", True), (ids[2], True, None, True), ("nobody", True, None, True), ("nobody", True, None, True)]
    out = transitions.route_outcomes(tasks, spark.createDataFrame(results, "id string, ok boolean, error string, known_type boolean"), NOW)
    assert out.tasks_delta.count() == out.history_delta.select("id").distinct().count() == out.history_delta.count() == 3
    assert {r.id: r.outcome for r in out.tasks_delta.collect()}[ids[2]] == "succeeded"
    assert out.not_found.count() == 1
    after = transitions.apply_transitions(tasks, out.tasks_delta.drop("outcome").unionByName(out.tasks_delta.drop("outcome")))
    assert after.count() == 4 and after.select("id").distinct().count() == 4


def test_repeated_failures_make_one_dead_letter(spark, table):  # noqa: F811
    tasks = table(task(1, "running"))
    one = tasks.first().id
    failures = spark.createDataFrame([(one, "b"), (one, "a"), (one, "b"), ("nobody", "z"), ("nobody", "z")], "id string, error_message string")
    out = transitions.dead_letter(tasks, failures, NOW)
    assert [r.error_message for r in out.dlq_delta.collect()] == ["a"]
    assert out.tasks_delta.count() == out.not_found.count() == 1


def test_marking_twice_keeps_the_outbox(spark):
    outbox = spark.createDataFrame([("a", "t", "{}", NOW, None), ("b", "t", "{}", NOW, None)], "id string, task_id string, payload string, created_at timestamp, published_at timestamp")
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    marked = dispatch.mark_published(outbox, ids, NOW)
    assert marked.count() == 2 and marked.where("published_at IS NULL").count() == 1


def test_series_do_not_bring_all_steps_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(metrics, "SERIES_SLICE", 600)
    samples = spark.range(5000).select(F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.when(F.col("id") % 5 == 0, "e").otherwise("").alias("error"))
    rows = metrics.live_rate(samples, "ts").orderBy("step_end").collect()
    sent = failed = 0
    for i, r in enumerate(rows):
        sent, failed = sent + 1, failed + (i % 5 == 0)
        assert (r.sent, r.err) == (sent, failed)


class Cluster:
    class sparkContext:
        master = "spark://host:7077"

    class conf:
        get = staticmethod(lambda key, default: default)


def test_a_cluster_must_name_its_shared_folder(spark):
    with pytest.raises(ValueError):
        sinks.shared_folder(Cluster)
    assert sinks.shared_folder(spark)
