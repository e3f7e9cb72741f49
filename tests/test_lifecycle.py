"""Operators on literal rows."""

import json
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide import schemas as S
from jobtide.functions import headers as HD
from jobtide.functions import scalars as X
from jobtide.operators import dispatch, handlers, ingest, lookups, metrics, sets, transitions
from jobtide.operators import history as H
from jobtide.plans.report import load_report
from jobtide.plans.tick import Store, lifecycle_tick, run_results, run_tick, save_tasks
from jobtide.sources import messages as M
from jobtide.sources import metric_text, requests, tables

NOW = datetime(2024, 1, 15, 12)
AS_OF = "2024-01-15 12:00:00"


def uid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"


def task(n, status="queued", **changes):
    row = dict(
        id=uid(n), name=f"job {n}", type="noop", payload={"to": "a@example.com"}, status=status, priority=0, retry_count=0,
        max_retries=3, timeout_seconds=30, idempotency_key=None, created_at=NOW - timedelta(hours=1),
        updated_at=NOW - timedelta(hours=1), run_after=NOW - timedelta(hours=1),
    )
    return tuple((row | changes)[c] for c in S.TASK_COLUMNS)


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), S.TASK)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def ids(spark, *numbers):
    return spark.createDataFrame([(uid(n),) for n in numbers], "id string")


# --- scalars -------------------------------------------------------------------------------------


def test_backoff_doubles_up_to_the_cap(spark):
    df = spark.range(41).select(X.backoff_seconds("id").alias("s"))
    got = [r.s for r in df.orderBy("id" if "id" in df.columns else "s").collect()]
    assert got[:8] == [5, 10, 20, 40, 80, 160, 300, 300] and got[-1] == 300


def test_terminal_statuses(spark):
    rows = [(s,) for s in (*S.STATUSES, "", None)]
    got = {r.s: r.t for r in spark.createDataFrame(rows, "s string").select("s", X.is_terminal("s").alias("t")).collect()}
    assert got == {"succeeded": True, "failed": True, "dead_lettered": True, "queued": False, "running": False, "": False, None: False}


@pytest.mark.parametrize(
    "text,ok",
    [
        (uid(7), True), (uid(0xAB).upper(), True), ("urn:uuid:" + uid(7), True), ("URN:UUID:" + uid(7), True), ("{" + uid(7) + "}", True),
        (uid(7).replace("-", ""), True), ("not-a-uuid", False), ("", False), (uid(7) + "0", False), ("x" + uid(7), False), (None, False),
    ],
)
def test_uuid_spellings(spark, text, ok):
    row = one(spark.createDataFrame([(text,)], "t string").select(X.canonical_uuid("t").alias("u"), X.check_task_id("t").alias("code")))
    if ok:
        assert row.code is None and len(row.u) == 36 and row.u == row.u.lower()
    else:
        assert row.u is None and row.code == S.INVALID_TASK_ID


def test_surrogate_ids_are_stable_and_look_like_uuids(spark):
    df = spark.createDataFrame([("a", NOW)], "a string, at timestamp").select(X.surrogate_id("a", "at").alias("id"))
    assert one(df).id == one(df).id and one(df.select(X.canonical_uuid("id").alias("u"))).u == one(df).id


def test_rfc3339_cuts_trailing_zeros(spark):
    times = [datetime(2024, 1, 1, 0, 0, 5), datetime(2024, 1, 1, 0, 0, 5, 120000), datetime(2024, 1, 1, 0, 0, 5, 1)]
    df = spark.createDataFrame([(t,) for t in times], "at timestamp")
    got = [r.t for r in df.select(X.rfc3339(df, "at").alias("t")).collect()]
    assert got == ["2024-01-01T00:00:05Z", "2024-01-01T00:00:05.12Z", "2024-01-01T00:00:05.000001Z"]


def test_route_and_severity(spark):
    df = spark.createDataFrame([(f"/tasks/{uid(3)}/history", 404), ("/health", 200), (f"/dlq/tasks/{uid(1)}", 503)], "path string, status int")
    got = [tuple(r) for r in df.select(X.route_pattern("path"), X.severity("status")).collect()]
    assert got == [("/tasks/{id}/history", "warn"), ("/health", "info"), ("/dlq/tasks/{id}", "error")]


def test_headers_first_match_replace_and_append(spark):
    made = HD.build_headers(a=F.lit("1"), b=F.lit("2"))
    twice = F.concat(made, HD.build_headers(a=F.lit("3")))
    df = spark.range(1).select(
        HD.get_header(twice, "a").alias("first"),
        HD.get_header(HD.set_header(twice, "a", F.lit("9")), "a").alias("changed"),
        HD.header_keys(HD.set_header(made, "c", F.lit("4"))).alias("keys"),
        HD.get_header(made, "zz").alias("absent"),
    )
    assert tuple(one(df)) == ("1", "9", ["a", "b", "c"], "")


# --- requests ------------------------------------------------------------------------------------


def parse(spark, *texts):
    return requests.parse_requests(spark.createDataFrame(list(enumerate(texts)), "n int, value string"))


@pytest.mark.parametrize(
    "body,code",
    [
        ('{"name":"welcome","type":"send_email","payload":{"to":"a"}}', "OK"),
        ('{"type":"send_email","payload":{}}', "NAME_REQUIRED"),
        ('{"name":"x","payload":{}}', "TYPE_REQUIRED"),
        ('{"name":"x","type":"nope","payload":{}}', "UNKNOWN_TASK_TYPE"),
        ('{"name":"x","type":"noop"}', "PAYLOAD_NULL"),
        ('{"name":"x","type":"noop","payload":null}', "PAYLOAD_NULL"),
        ("{not json", "INVALID_JSON_BODY"),
        ('{"name":"x","type":"noop","payload":{"k":69}}', "INVALID_JSON_BODY"),
        ('{"name":"x","type":"noop","payload":{},"priority":"7"}', "INVALID_JSON_BODY"),
        ('{"name":"x","type":"noop","payload":{},"priority":7.5}', "INVALID_JSON_BODY"),
        ('{"name":"x","type":"noop","payload":{"k":null},"other":1}', "OK"),
        ('{"name":5,"type":"noop","payload":{}}', "INVALID_JSON_BODY"),
        ("", "INVALID_JSON_BODY"),
        ("[1]", "INVALID_JSON_BODY"),
    ],
)
def test_first_broken_rule_decides(spark, body, code):
    row = one(ingest.validate_requests(parse(spark, body)))
    assert row.code == code
    if code == "UNKNOWN_TASK_TYPE":
        assert row.message == 'unknown task type "nope"'


@pytest.mark.parametrize("priority,retries,timeout", [(0, 1, 1), (-7, 9, 86_400), (2_147_483_647, 3, 30)])
def test_every_field_of_a_request_is_kept(spark, priority, retries, timeout):
    payload = {"": "blank name", "é \\ \"": "line\nbreak", "n": ""}
    body = {"type": "noop", "timeout_seconds": timeout, "payload": payload, "name": " spaced ", "priority": priority, "max_retries": retries}
    req = parse(spark, json.dumps(body)).withColumn("id", F.lit(uid(8)))
    made = ingest.create_tasks(req, AS_OF)
    row = one(lookups.lookup_tasks(made.tasks, ids(spark, 8)))
    assert (row.found, row.name, row.payload) == (True, " spaced ", payload)
    assert (row.priority, row.max_retries, row.timeout_seconds) == (priority, retries, timeout)
    assert (row.status, row.retry_count, row.idempotency_key) == ("queued", 0, None)
    assert {row.created_at, row.updated_at, row.run_after, one(made.history).occurred_at} == {NOW}
    assert json.loads(one(made.outbox).payload) == body | {"task_id": uid(8)}


def test_defaults_zero_means_not_given_and_negatives_pass(spark):
    df = spark.createDataFrame([(0, 0, ""), (-1, 5, "k")], "max_retries int, timeout_seconds int, idempotency_key string").withColumn("priority", F.lit(None).cast("int"))
    got = [tuple(r) for r in ingest.apply_request_defaults(df, AS_OF).select("max_retries", "timeout_seconds", "idempotency_key", "priority").collect()]
    assert got == [(3, 30, None, 0), (-1, 5, "k", 0)]


def batch_file(spark, tmp_path, *batches):
    (tmp_path / "in.json").write_text("\n".join(batches))
    return requests.read_request_batches(spark, str(tmp_path / "in.json"))


GOOD = '{"name":"x","type":"noop","payload":{}}'


def test_batches_pass_or_fail_as_a_whole(spark, tmp_path):
    big = "[" + ",".join([GOOD] * 1001) + "]"
    full = "[" + ",".join([GOOD] * 1000) + "]"
    bad = f'[{GOOD},{{"name":"","type":"noop","payload":{{}}}},{{"type":""}}]'
    req = batch_file(spark, tmp_path, "[]", big, full, bad, "{}", f'[{GOOD},{{"name":1}}]')
    got = {(r.code, r.size): (r.bad_idx, r.message) for r in ingest.validate_batches(req).collect()}
    assert got == {
        ("EMPTY_BATCH", 0): (None, "batch must not be empty"),
        ("BATCH_TOO_LARGE", 1001): (None, "batch size must not exceed 1000"),
        ("OK", 1000): (None, None),
        ("NAME_REQUIRED", 3): (1, "task[1]: name is required"),
        ("INVALID_JSON_BODY", 0): (None, "invalid JSON body"),
        ("INVALID_JSON_BODY", 2): (None, "invalid JSON body"),
    }
    numbered = req.withColumn("id", X.surrogate_id("batch_id", "idx"))
    batches, made = ingest.create_task_batches(numbered, AS_OF)
    assert made.tasks.count() == 1000 and batches.count() == 6


def test_strict_batches_refuse_a_taken_key(spark, table):
    def row(batch, idx, key):
        return (batch, idx, uid(10 * idx + ord(batch)), "x", "noop", {}, 0, 0, 0, key)

    schema = "batch_id string, idx int, id string, name string, type string, payload map<string,string>, priority int, max_retries int, timeout_seconds int, idempotency_key string"
    req = spark.createDataFrame([row("a", 0, "new"), row("a", 1, ""), row("b", 0, "old"), row("c", 0, "twin"), row("c", 1, "twin")], schema)
    stored = table(task(1, idempotency_key="old"))
    codes = {r.batch_id: r.code for r in ingest.create_task_batches(req, AS_OF, stored, strict=True)[0].collect()}
    assert codes == {"a": "OK", "b": "DUPLICATE_KEY", "c": "DUPLICATE_KEY"}
    loose = ingest.create_task_batches(req, AS_OF, stored)[1]
    assert loose.tasks.count() == 3
    assert {r.outcome for r in loose.outcomes.collect()} == {"CREATED", "EXISTING"}


def test_known_types_from_a_table(spark):
    req = spark.createDataFrame([("noop",), ("other",), (None,)], "type string")
    registry = spark.createDataFrame([("noop",), ("noop",)], "type string")
    assert [r.type for r in ingest.known_types(req, registry).collect()] == ["noop"]
    assert ingest.known_types(req, registry, known=False).count() == 2


# --- state changes -------------------------------------------------------------------------------


def test_higher_priority_is_claimed_first_and_ties_go_by_age_then_id(spark, table):
    old = NOW - timedelta(hours=2)
    tasks = table(task(1, priority=1, created_at=old), task(2, priority=100), task(4, priority=1), task(3, priority=1))
    order = [r.id for r in transitions.claim_topk(tasks, 10, AS_OF).collect()]
    assert order == [uid(2), uid(1), uid(3), uid(4)]


def test_nothing_due_gives_nothing(spark, table):
    tasks = table(task(1, run_after=NOW + timedelta(seconds=1)), task(2, "running"))
    assert transitions.claim_topk(tasks, 5, AS_OF).count() == 0
    assert transitions.claim_topk(table(task(3, run_after=NOW)), 5, AS_OF).count() == 1


def test_two_claims_in_a_row_are_disjoint_and_workers_share_nothing(spark, table):
    tasks = table(*[task(n, priority=n % 3) for n in range(20)])
    first = transitions.claim(tasks, 7, AS_OF, workers=3)
    after = transitions.apply_transitions(tasks, first.tasks_delta)
    second = transitions.claim(after, 7, AS_OF)
    a = {r.id for r in first.tasks_delta.collect()}
    b = {r.id for r in second.tasks_delta.collect()}
    assert len(a) == len(b) == 7 and not a & b
    dealt = [(r.worker, r.id) for r in first.dispatch_delta.collect()]
    assert sorted(w for w, _ in dealt) == [0, 0, 0, 1, 1, 2, 2] and len({i for _, i in dealt}) == 7


def test_requeue_waits_by_the_old_count(spark, table):
    tasks = table(task(1, "running"), task(2, "running", retry_count=10))
    moved = transitions.requeue(tasks, ids(spark, 1, 2, 9), AS_OF)
    got = {r.id: (r.status, r.retry_count, r.run_after) for r in moved.tasks_delta.collect()}
    assert got == {uid(1): ("queued", 1, NOW + timedelta(seconds=5)), uid(2): ("queued", 11, NOW + timedelta(seconds=300))}
    assert [r.id for r in moved.not_found.collect()] == [uid(9)]
    assert moved.history_delta.count() == moved.dispatch_delta.count() == 2
    after = transitions.apply_transitions(tasks, moved.tasks_delta)
    assert transitions.claimable(after, AS_OF).count() == 0
    assert transitions.claimable(after, "2024-01-15 12:00:05").count() == 1
    assert transitions.requeue(tasks, ids(spark, 1), AS_OF, with_history=False).history_delta is None


def test_dead_letter_and_retry_round_trip(spark, table):
    tasks = table(task(1, "running", retry_count=3))
    failures = spark.createDataFrame([(uid(1), "connection refused"), (uid(9), "x")], "id string, error_message string")
    moved = transitions.dead_letter(tasks, failures, AS_OF)
    dead = one(moved.dlq_delta)
    assert (dead.original_task_id, dead.error_message, dead.retry_count, dead.dead_lettered_at) == (uid(1), "connection refused", 3, NOW)
    assert dead.original_created_at == NOW - timedelta(hours=1)
    assert one(moved.history_delta).status == "dead_lettered" and one(moved.not_found).id == uid(9)
    after = transitions.apply_transitions(tasks, moved.tasks_delta)
    assert one(after).status == "dead_lettered" and one(after).retry_count == 3
    assert one(dispatch.dlq_list(moved.dlq_delta)).name == "job 1"

    asked = spark.createDataFrame([(dead.id,), (uid(8),)], "id string")
    back = transitions.dlq_retry(moved.dlq_delta, after, asked, AS_OF)
    assert one(back.not_found).id == uid(8) and back.dlq_after.count() == 0
    again = transitions.apply_transitions(after, back.tasks_delta)
    assert (one(again).status, one(again).retry_count) == ("queued", 0)
    assert one(back.history_delta).status == "queued" and transitions.claimable(again, AS_OF).count() == 1


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, ok boolean, error string, known_type boolean")


def test_retries_run_out_after_max_retries_plus_one_attempts(spark, table):
    tasks, outcomes, clock = table(task(1, max_retries=2)), [], NOW
    log = []
    for _ in range(3):
        claimed = transitions.claim(tasks, 1, str(clock))
        tasks = transitions.apply_transitions(tasks, claimed.tasks_delta)
        routed = transitions.route_outcomes(tasks, results(spark, (uid(1), False, "boom", True)), str(clock))
        outcomes.append(one(routed.tasks_delta).outcome)
        log += [r.status for r in claimed.history_delta.collect()] + [r.status for r in routed.history_delta.collect()]
        tasks = spark.createDataFrame(transitions.apply_transitions(tasks, routed.tasks_delta.drop("outcome")).collect(), S.STORED_TASK)
        clock += timedelta(minutes=10)
    assert outcomes == ["retry", "retry", "dead_lettered"]
    assert one(routed.dlq_delta).error_message == "boom" and one(tasks).retry_count == 2
    assert log == ["running", "queued", "running", "queued", "running", "dead_lettered"]


def test_outcomes_of_success_and_unknown_type(spark, table):
    tasks = table(task(1, "running"), task(2, "running"))
    routed = transitions.route_outcomes(tasks, results(spark, (uid(1), True, None, True), (uid(2), False, None, False), (uid(9), True, None, True)), AS_OF)
    got = {r.id: (r.status, r.retry_count) for r in routed.tasks_delta.collect()}
    assert got == {uid(1): ("succeeded", 0), uid(2): ("failed", 0)}
    assert routed.dlq_delta.count() == routed.dispatch_delta.count() == 0 and one(routed.not_found).id == uid(9)
    counted = metrics.processed_by_type_status(transitions.failure_route(tasks, results(spark, (uid(1), True, None, True), (uid(2), False, None, False))))
    assert [tuple(r) for r in counted.collect()] == [("noop", "succeeded", 1)]


def test_reap_takes_only_runs_past_their_deadline(spark, table):
    at = NOW - timedelta(seconds=30)
    tasks = table(
        task(1, "running", updated_at=at),  # exactly at the deadline: not yet
        task(2, "running", updated_at=at - timedelta(microseconds=1)),
        task(3, "running", updated_at=at - timedelta(hours=1), retry_count=3),
        task(4, "succeeded", updated_at=at - timedelta(hours=1)),
    )
    moved = transitions.reap(tasks, AS_OF)
    got = {r.id: (r.status, r.retry_count, r.run_after) for r in moved.tasks_delta.collect()}
    assert got == {uid(2): ("queued", 1, NOW), uid(3): ("dead_lettered", 3, NOW - timedelta(hours=1))}
    assert one(moved.dlq_delta).error_message == S.REAPED_MESSAGE and one(moved.dispatch_delta).task_id == uid(2)
    after = transitions.apply_transitions(tasks, moved.tasks_delta.drop("outcome"))
    assert transitions.reap(after, AS_OF).tasks_delta.count() == 0
    assert {r.outcome: r.n for r in metrics.reap_counts(transitions.reap_plan(after, AS_OF)).collect()} == {"requeued": 0, "dead_lettered": 0}


def test_a_run_that_finished_is_not_reaped(spark, table):
    tasks = table(task(1, "running"))
    done = transitions.route_outcomes(tasks, results(spark, (uid(1), True, None, True)), AS_OF)
    after = transitions.apply_transitions(tasks, done.tasks_delta.drop("outcome"))
    assert transitions.reap(after, AS_OF).tasks_delta.count() == 0


def test_set_status_takes_the_last_update_and_reports_unknown_ids(spark, table):
    updates = spark.createDataFrame([(uid(1), "running", 1), (uid(1), "odd", 2), (uid(9), "x", 1)], "id string, status string, seq int")
    moved = transitions.set_status(table(task(1)), updates, AS_OF, order="seq")
    assert one(moved.tasks_delta).status == "odd" and moved.history_delta.count() == 2 and one(moved.not_found).id == uid(9)


def test_tick_touches_each_task_once(spark, table):
    tasks = table(*[task(n, ("queued", "running", "succeeded")[n % 3]) for n in range(30)])
    tick = lifecycle_tick(tasks, AS_OF, k=4)
    assert tick.tasks_after.count() == 30
    assert {r.status: r["count"] for r in tick.tasks_after.groupBy("status").count().collect()} == {"queued": 16, "running": 4, "succeeded": 10}
    assert tick.history.count() == 14


def test_ticks_on_files_can_be_run_again(spark, table, tmp_path):
    store = Store(str(tmp_path))
    save_tasks(table(*[task(n, "queued" if n % 2 else "running", retry_count=n % 5) for n in range(12)]), store, 0)
    run_tick(spark, store, 1, AS_OF, k=2)
    read = lambda name: sorted(map(str, spark.read.parquet(store.path(name)).collect()))
    once = {name: read(name) for name in ("tasks", "history", "dlq", "claimed", "outbox")}
    run_tick(spark, store, 1, AS_OF, k=2)
    assert {name: read(name) for name in once} == once
    run_tick(spark, store, 2, "2024-01-15 12:10:00", k=100)
    log = spark.read.parquet(store.path("history"))
    last = {r.task_id: r.status for r in H.current_state(log).collect()}
    now = {r.id: r.status for r in store.tasks(spark, 2).collect()}
    assert all(now[i] == s for i, s in last.items()) and len(now) == 12
    assert spark.read.parquet(store.path("dlq")).count() == sum(s == "dead_lettered" for s in now.values())


def test_claim_run_and_route_on_files_runs_each_handler_once(spark, table, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def work(payload, deadline):
        (calls / f"{payload['n']}-{len(list(calls.iterdir()))}").touch()
        if int(payload["n"]) % 2:
            raise ValueError("odd")

    store = Store(str(tmp_path / "db"))
    save_tasks(table(*[task(n, payload={"n": str(n)}, retry_count=3 if n == 1 else 0) for n in range(6)]), store, 0)
    run_tick(spark, store, 1, AS_OF, k=4)
    claimed = tables.decoded(spark.read.parquet(store.path("claimed") + "/batch_id=1"))
    results = handlers.execute_once(claimed, {"noop": work})
    run_results(spark, store, 2, results, "2024-01-15 12:01:00")
    assert len(list(calls.iterdir())) == 4
    now = {int(r.id[-2:]): (r.status, r.retry_count) for r in store.tasks(spark, 2).collect()}
    assert now == {0: ("succeeded", 0), 1: ("dead_lettered", 3), 2: ("succeeded", 0), 3: ("queued", 1), 4: ("queued", 0), 5: ("queued", 0)}
    assert one(spark.read.parquet(store.path("dlq"))).error_message == "odd"
    log = spark.read.parquet(store.path("history"))
    assert {int(r.task_id[-2:]): r.status for r in H.current_state(log).collect()} == {0: "succeeded", 1: "dead_lettered", 2: "succeeded", 3: "queued"}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(S.STATUSES), st.integers(0, 5), st.integers(0, 4), st.integers(-100, 100)), min_size=1, max_size=25
    ),
    st.integers(1, 10),
)
def test_deltas_change_what_they_say_and_keep_the_rest(spark, rows, k):
    tasks = spark.createDataFrame(
        [task(n, s, priority=p, retry_count=r, updated_at=NOW + timedelta(seconds=d)) for n, (s, p, r, d) in enumerate(rows)], S.TASK
    )
    before = {r.id: r for r in tasks.collect()}
    tick = lifecycle_tick(tasks, AS_OF, k)
    claimed = {r.id for r in tick.claimed.tasks_delta.collect()}
    reaped = {r.id for r in tick.reaped.tasks_delta.collect()}
    after = {r.id: r for r in tick.tasks_after.collect()}
    assert set(after) == set(before) and not claimed & reaped
    assert len(claimed) == min(k, sum(r.status == "queued" for r in before.values()))
    assert all(after[i] == before[i] for i in before if i not in claimed | reaped)
    assert all(after[i].status == "running" for i in claimed)
    assert tick.history.count() == len(claimed) + len(reaped)


# --- history -------------------------------------------------------------------------------------


def log(spark, *rows):
    return spark.createDataFrame([(f"h{i}", uid(t), s, NOW + timedelta(seconds=sec)) for i, (t, s, sec) in enumerate(rows)], S.TASK_HISTORY)


def test_legal_life_has_no_findings_and_illegal_steps_do(spark):
    legal = [(1, "queued", 0), (1, "running", 1), (1, "queued", 2), (1, "running", 9), (1, "dead_lettered", 10), (1, "queued", 20), (1, "running", 21), (1, "failed", 22)]
    assert H.lifecycle_audit(log(spark, *legal)).count() == 0
    found = H.lifecycle_audit(log(spark, (2, "running", 0), (2, "succeeded", 1), (2, "queued", 2))).collect()
    assert {(r.prev_status, r.status) for r in found} == {("start", "running"), ("succeeded", "queued")}


def test_waits_runs_attempts_and_end_to_end(spark):
    rows = [(1, "queued", 0), (1, "running", 4), (1, "queued", 10), (1, "running", 15), (1, "succeeded", 7200), (2, "queued", 0), (2, "running", 3)]
    df = log(spark, *rows)
    assert sorted(r.wait_seconds for r in H.queue_wait(df).collect()) == [3.0, 4.0, 5.0]
    assert {(r.outcome, r.duration_seconds) for r in H.execution_duration(df).collect()} == {("retry", 6.0), ("succeeded", 7185.0)}
    assert [r.attempt for r in H.attempts(df).where(F.col("task_id") == uid(1)).orderBy("occurred_at").collect()] == [0, 1, 1, 2, 2]
    e2e = one(H.e2e_latency(df, spark.createDataFrame([(uid(1), "noop")], "id string, type string")))
    assert (e2e.task_id, e2e.type, e2e.status, e2e.e2e_seconds) == (uid(1), "noop", "succeeded", 7200.0)
    assert {r.task_id: r.status for r in H.current_state(df).collect()} == {uid(1): "succeeded", uid(2): "running"}


def test_rows_of_one_call_agree_with_its_table(spark, table):
    tasks = table(*[task(n) for n in range(8)])
    updates = spark.createDataFrame([(uid(n), s) for n in range(8) for s in ("running", "succeeded")], "id string, status string")
    moved = transitions.set_status(tasks, updates, AS_OF)
    assert {r.task_id: r.status for r in H.current_state(moved.history_delta).collect()} == {r.id: r.status for r in moved.tasks_delta.collect()}
    born = ingest.history_rows(tasks, "queued", F.lit(NOW).cast("timestamp"))
    claimed = transitions.claim(tasks, 8, AS_OF).history_delta
    assert H.lifecycle_audit(born.unionByName(claimed)).count() == 0


def test_ties_in_time_go_by_id(spark):
    df = log(spark, (1, "queued", 0), (1, "running", 0), (1, "succeeded", 0))
    assert one(H.current_state(df)).status == "succeeded"
    assert [r.prev_status for r in H.transitions(df).orderBy("id").collect()] == [None, "queued", "running"]


def test_month_layout_prunes_and_round_trips(spark, tmp_path):
    rows = [(1, "queued", 0), (1, "running", 60 * 86400), (2, "queued", -60 * 86400), (2, "running", 1)]
    flat, monthly, back = (str(tmp_path / n) for n in ("flat", "monthly", "back"))
    log(spark, *rows).write.parquet(flat)
    tables.repartition_history(spark, flat, monthly)
    assert {p.name for p in (tmp_path / "monthly").glob("event_month=*")} == {"event_month=2023-11", "event_month=2024-01", "event_month=2024-03"}
    ranged = tables.read_history(spark, monthly, "2024-01-01 00:00:00", "2024-02-01 00:00:00")
    plan = ranged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan and ranged.count() == 2
    tables.flatten_history(spark, monthly, back)
    assert sets.snapshot_diff(spark.read.parquet(flat), spark.read.parquet(back)).count() == 0


def test_append_makes_ids_that_do_not_change(spark, tmp_path):
    events = log(spark, (1, "queued", 0)).drop("id")
    for name in ("a", "b"):
        tables.append_history(events, str(tmp_path / name))
    a, b = (one(tables.read_history(spark, str(tmp_path / n))) for n in ("a", "b"))
    assert a == b and a.id


def test_snapshot_diff_counts_duplicates(spark):
    old = spark.createDataFrame([("a",), ("a",), ("b",)], "x string")
    new = spark.createDataFrame([("a",), ("c",)], "x string")
    assert {tuple(r) for r in sets.snapshot_diff(old, new).collect()} == {("a", "lost", 1), ("b", "lost", 1), ("c", "gained", 1)}


# --- storage, messages, measures -----------------------------------------------------------------


def test_task_table_round_trip_and_broken_payload(spark, table, tmp_path):
    tables.write_tasks(table(task(1), task(2, "running", payload={})), str(tmp_path / "t"))
    back = {r.id: r.payload for r in tables.read_tasks(spark, str(tmp_path / "t")).collect()}
    assert back == {uid(1): {"to": "a@example.com"}, uid(2): {}}
    tables.encoded(table(task(3))).withColumn("payload", F.lit("{oops")).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(PySparkException):
        tables.read_tasks(spark, str(tmp_path / "bad")).collect()
    assert one(tables.read_tasks(spark, str(tmp_path / "bad"), strict=False)).id == uid(3)


def test_wire_round_trip(spark, table):
    sent = [
        task(4, payload={}, priority=-1, max_retries=0, timeout_seconds=1, retry_count=0, idempotency_key=" "),
        task(5, payload={"q": "\"'\\", "ü": "\t"}, priority=2, max_retries=1, timeout_seconds=7, retry_count=1),
        task(6, payload=None, idempotency_key="k" * 300),
    ]
    rows = M.to_task_messages(table(*sent)).withColumns({"partition": F.lit(0), "offset": F.lit(0), "timestamp": F.lit(NOW)})
    good, bad = M.parse_task_messages(rows)
    assert bad.count() == 0
    got = {r.task_id: r for r in good.collect()}
    assert set(got) == {uid(4), uid(5), uid(6)}
    for values in sent:
        want = dict(zip(S.TASK_COLUMNS, values))
        row = got[want["id"]]
        assert row.payload == (want["payload"] or {}) and row.idempotency_key == (want["idempotency_key"] or "")
        assert all(row[c] == want[c] for c in ("name", "type", "priority", "max_retries", "timeout_seconds", "retry_count"))
        assert row.meta == {"partition": "0", "offset": "0", "topic": "tasks"}
    assert "idempotency_key" not in json.loads(bytes(one(M.to_task_messages(table(task(2)))).value))
    assert M.to_dlq_messages(table(task(1)), F.lit("x"), topic=None).count() == 0


def test_bad_wire_goes_to_quarantine(spark):
    values = ["{not json", '{"task_id":"not-a-uuid","name":"x","type":"y"}', '{"task_id":7}', '{"name":"x"}']
    rows = spark.createDataFrame([(bytearray(v, "utf8"), "tasks", 0, i, NOW) for i, v in enumerate(values)], "value binary, topic string, partition int, offset bigint, timestamp timestamp")
    good, bad = M.parse_task_messages(rows)
    assert good.count() == 0
    assert {r.offset: r.reject_reason for r in bad.collect()} == {0: "bad_json", 1: "bad_task_id", 2: "bad_json", 3: "bad_task_id"}


def test_outbox_poll_prune_and_mark(spark):
    def row(i, age, published=None):
        return (f"o{i}", uid(i), "{}", NOW - timedelta(seconds=age), published and NOW - timedelta(seconds=published))

    box = spark.createDataFrame([row(1, 10), row(2, 20), row(3, 9000, 3600), row(4, 9000, 3601)], S.OUTBOX)
    assert [r.id for r in dispatch.outbox_poll(box, 1).collect()] == ["o2"]
    assert {r.id for r in dispatch.outbox_prune(box, AS_OF).collect()} == {"o1", "o2", "o3"}
    assert {r.id for r in dispatch.outbox_prunable(box, AS_OF).collect()} == {"o4"}
    marked = dispatch.mark_published(box, dispatch.outbox_poll(box), AS_OF)
    assert one(metrics.outbox_depth(box)).depth == 2 and one(metrics.outbox_depth(marked)).depth == 0


def test_empty_tables_give_zero_not_nothing(spark):
    empty = spark.createDataFrame([], S.DEAD_LETTER)
    assert one(metrics.dlq_depth(empty)).depth == 0 and dispatch.dlq_list(empty).collect() == []
    samples = spark.createDataFrame([], "error string, at timestamp")
    assert one(metrics.error_rate(samples)).error_rate is None
    assert one(metrics.throughput(samples, "at")).per_second is None


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("a", v) for v in (0.5, 1.0, 1.5, 3.0, 100.0)] + [("b", 100.0)], "k string, v double")
    hist = metrics.histogram(df, "v", (1.0, 2.0, 4.0), ["k"])
    got = [(r.le, r.cumulative) for r in hist.where("k = 'a'").orderBy("le").collect()]
    assert got == [(1.0, 2), (2.0, 3), (4.0, 4), (float("inf"), 5)]
    for q, want in ((0.2, 0.5), (0.5, 1.5), (0.95, 4.0)):
        a = {r.k: r.quantile for r in metrics.histogram_quantile(hist, q, ["k"]).collect()}
        b = {r.k: r.quantile for r in metrics.value_quantile(df, "v", (1.0, 2.0, 4.0), q, ["k"]).collect()}
        assert a == b and a == {"a": pytest.approx(want), "b": 4.0}


def test_live_rate_and_series(spark):
    rows = [(NOW + timedelta(seconds=s), e) for s, e in ((0, ""), (1, "x"), (2, ""), (3, None), (7, ""))]
    got = [tuple(r)[1:] for r in metrics.live_rate(spark.createDataFrame(rows, "at timestamp, error string"), "at").orderBy("step_end").collect()]
    assert got == [(2, 1, 1, 0.5, 0.5), (4, 3, 1, 1.0, 0.75), (5, 4, 1, 0.5, 0.5)]
    life = log(spark, (1, "running", 0), (1, "dead_lettered", 10), (1, "queued", 3700), (2, "running", 3800))
    assert [(r.delta, r.depth) for r in metrics.dlq_depth_series(life).orderBy("step_start").collect()] == [(1, 1), (-1, 0)]
    assert [r.depth for r in metrics.in_progress_series(life).orderBy("step_start").collect()] == [0, 1]


def test_consumer_lag_without_commit_and_never_negative(spark):
    messages = spark.createDataFrame([("t", 0, 9), ("t", 1, 2999), ("t", 2, 5)], "topic string, partition int, offset bigint")
    commits = spark.createDataFrame([("t", 0, 4), ("t", 2, 50)], "topic string, partition int, committed bigint")
    got = {r.partition: (r.lag, r.over_threshold) for r in metrics.consumer_lag(messages, commits).collect()}
    assert got == {0: (6, False), 1: (3000, True), 2: (0, False)}


def test_metric_lines(spark, tmp_path):
    (tmp_path / "m.txt").write_text(
        "# TYPE tasks_created_total counter\n"
        'tasks_created_total{type="send_email"} 12\n'
        "worker_tasks_in_progress 3\n"
        'worker_task_duration_seconds_bucket{type="a b",status="retry",le="+Inf"} 1.5e+03\n'
        "go_goroutines 8\n"
    )
    got = {(r.name, tuple(sorted(r.labels.items())), r.sample) for r in metric_text.read_metric_text(spark, str(tmp_path / "m.txt")).collect()}
    assert got == {
        ("tasks_created_total", (("type", "send_email"),), 12.0),
        ("worker_tasks_in_progress", (), 3.0),
        ("worker_task_duration_seconds_bucket", (("le", "+Inf"), ("status", "retry"), ("type", "a b")), 1500.0),
    }


def test_handlers_errors_unknown_types_and_deadlines(spark, table):
    def fail(payload, deadline):
        raise ValueError("no " + payload["to"])

    def slow(payload, deadline):
        assert deadline.remaining() <= 0
        deadline.check()

    tasks = table(task(1), task(2, type="bad"), task(3, type="late", timeout_seconds=0), task(4, type="who"))
    ran = handlers.execute(tasks, {"noop": handlers.noop, "bad": fail, "late": slow}, partitions=2)
    got = {r.id: (r.ok, r.error, r.known_type) for r in ran.collect()}
    assert got == {
        uid(1): (True, None, True), uid(2): (False, "no a@example.com", True), uid(3): (False, "deadline exceeded", True), uid(4): (False, None, False),
    }
    assert ran.schema["id"].dataType == T.StringType()


def test_dlq_and_outbox_tables_round_trip(spark, table, tmp_path):
    failures = spark.createDataFrame([(uid(1), ""), (uid(2), "ошибка\n"), (uid(3), None)], "id string, error_message string")
    dead, _ = transitions.dlq_snapshot(failures, table(task(1), task(2, payload={"x": ""}), task(3, payload={})), AS_OF)
    tables.write_dlq(dead, str(tmp_path / "dlq"))
    back = {r.original_task_id: r for r in tables.read_dlq(spark, str(tmp_path / "dlq")).collect()}
    assert {k: r.error_message for k, r in back.items()} == {uid(1): "", uid(2): "ошибка\n", uid(3): ""}
    assert (back[uid(2)].payload, back[uid(3)].payload) == ({"x": ""}, {})
    made = table(task(8, payload={"a": "1"}, priority=-4, idempotency_key=""), task(9, payload=None, retry_count=2, idempotency_key="z"))
    tables.write_outbox(made, str(tmp_path / "outbox"), AS_OF)
    rows = {r.task_id: r for r in tables.read_outbox(spark, str(tmp_path / "outbox")).collect()}
    assert (rows[uid(8)].message.payload, rows[uid(8)].message.priority, rows[uid(8)].message.idempotency_key) == ({"a": "1"}, -4, None)
    assert (rows[uid(9)].message.payload, rows[uid(9)].message.idempotency_key) == ({}, "z")
    for r in rows.values():
        assert r.published_at is None and "retry_count" not in json.loads(r.payload) and r.message.task_id == r.task_id


def test_durations_are_cut_not_rounded(spark):
    df = spark.createDataFrame([(0.29,), (1.9999,), (0.0,)], "s double")
    assert [tuple(r) for r in df.select(X.truncate_ms("s"), X.truncate_seconds("s")).collect()] == [(0.29, 0), (1.999, 1), (0.0, 0)]


def test_report_of_creation_only(spark):
    rows = [(NOW + timedelta(seconds=i), "" if i % 5 else "refused", i / 10) for i in range(21)]
    got = {(r.section, r.measure): r.value for r in load_report(spark.createDataFrame(rows, "created_at timestamp, error string, latency_seconds double")).collect()}
    assert got[("create", "created")] == 16 and got[("create", "errors")] == 5
    assert got[("create_latency", "p50")] == 0.9 and got[("create_latency", "p999")] == 1.9
    assert got[("create_rate", "per_second")] == 16 / 18 and not any(s.startswith("finish") for s, _ in got)
