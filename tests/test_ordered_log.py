"""Rows of one instant: the log of any state changes folds to the table they leave."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.operators import history as H
from jobtide.operators import ingest, sets, transitions
from jobtide.operators.sliced import with_place
from jobtide.sources import messages as M
from jobtide.sources import tables
from tests.test_lifecycle import AS_OF, NOW, ids, log, one, results, table, task, uid  # noqa: F401  (a fixture)


def settled(spark, df):
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.mark.parametrize("seed", range(4))
def test_any_calls_at_one_instant_fold_to_their_table(spark, table, seed):
    rng = random.Random(seed)
    tasks, parts = table(*[task(n, rng.choice(S.STATUSES), retry_count=n % 5, idempotency_key=None) for n in range(12)]), []
    dead = None
    for _ in range(5):
        kind = rng.choice(["claim", "set", "requeue", "dead", "retry", "route", "reap"])
        some = ids(spark, *rng.sample(range(14), 6))
        if kind == "claim":
            moved = transitions.claim(tasks, 3, AS_OF)
        elif kind == "set":
            updates = spark.createDataFrame([(uid(rng.randrange(12)), rng.choice(S.STATUSES), rng.randrange(4)) for _ in range(15)], "id string, status string, place int")
            moved = transitions.set_status(tasks, updates, AS_OF, order=rng.choice([None, "place"]))
        elif kind == "requeue":
            moved = transitions.requeue(tasks, some, AS_OF)
        elif kind == "retry" and dead is not None:
            moved = transitions.dlq_retry(dead, tasks, dead.select("id"), AS_OF)
        elif kind == "route":
            moved = transitions.route_outcomes(tasks, results(spark, *[(uid(n), n % 2 == 0, "boom", n % 5 > 0) for n in range(6)]), AS_OF)
        elif kind == "reap":
            moved = transitions.reap(tasks, AS_OF)
        else:
            moved = transitions.dead_letter(tasks, some.withColumn("error_message", F.lit("x")), AS_OF)
            dead = settled(spark, moved.dlq_delta)
        delta = moved.tasks_delta.drop("outcome")
        parts.append(settled(spark, moved.history_delta))
        # Deliveries may be repeated.
        tasks = settled(spark, transitions.apply_transitions(tasks, delta.unionByName(delta)))
    whole = sets.append_deltas(*parts)
    assert whole.count() == whole.select("id").distinct().count() == whole.select("task_id", "seq").distinct().count()
    state = {r.task_id: r.status for r in H.current_state(whole).collect()}
    after = {r.id: r.status for r in tasks.collect()}
    assert state and all(after[i] == s for i, s in state.items())
    changed = {r.task_id: r.n for r in whole.groupBy("task_id").agg(F.count("*").alias("n")).collect()}
    assert {r.id: r.seq for r in tasks.collect() if r.seq} == changed


def test_dead_letter_and_retry_at_one_instant(spark, table):
    tasks = table(*[task(n, "running") for n in range(4)])
    lost = transitions.dead_letter(tasks, ids(spark, *range(4)).withColumn("error_message", F.lit("x")), AS_OF)
    after = transitions.apply_transitions(tasks, lost.tasks_delta)
    back = transitions.dlq_retry(lost.dlq_delta, after, lost.dlq_delta.select("id"), AS_OF)
    both = lost.history_delta.unionByName(back.history_delta)
    assert {r.status for r in H.current_state(both).collect()} == {"queued"}
    assert {(r.prev_status, r.status) for r in H.transitions(both).collect()} == {(None, "dead_lettered"), ("dead_lettered", "queued")}
    assert [r.status for r in H.task_timeline(both).collect()] == ["dead_lettered", "queued"] * 4


@pytest.mark.parametrize("statuses", [["running", "queued"], ["succeeded", "dead_lettered"], ["queued", "queued", "running", "zzz", "queued"]])
def test_the_fold_of_one_call_is_its_last_update(spark, table, statuses):
    tasks = table(*[task(n) for n in range(3)])
    rows = [(uid(n), s, i) for n in range(3) for i, s in enumerate(statuses)]
    updates = spark.createDataFrame(rows + rows[::-1], "id string, status string, place int").repartition(3)
    moved = transitions.set_status(tasks, updates, AS_OF, order="place")
    assert {r.task_id: r.status for r in H.current_state(moved.history_delta).collect()} == {uid(n): statuses[-1] for n in range(3)}
    assert [r.status for r in moved.history_delta.where(F.col("task_id") == uid(1)).orderBy("seq").collect()] == statuses
    assert moved.tasks_delta.count() == 3 and moved.history_delta.select("id").distinct().count() == len(rows)


def test_updates_without_a_task_or_an_order(spark, table):
    tasks = table(task(1))
    updates = spark.createDataFrame([(uid(1), "a"), (uid(1), "b"), (uid(1), "b"), (uid(9), "c"), (None, "d")], "id string, status string")
    moved = transitions.set_status(tasks, updates, AS_OF)
    assert [(r.status, r.seq) for r in moved.history_delta.collect()] == [("b", 1)] == [(r.status, r.seq) for r in moved.tasks_delta.collect()]
    assert {r.id for r in moved.not_found.collect()} == {uid(9), None}


def test_numeric_and_text_ids_tie_in_their_own_order(spark):
    for kind, want in (("int", 10), ("string", "9")):
        rows = [(9, "running"), (10, "queued")]
        df = spark.createDataFrame(rows, "id int, status string").select(F.col("id").cast(kind).alias("id"), F.lit("t").alias("task_id"), "status", F.lit(NOW).alias("occurred_at"))
        assert one(H.current_state(df)).id == want == H.transitions(df).where("prev_status IS NOT NULL").first().id == H.task_timeline(df).collect()[-1].id


def test_repeated_deltas_fold_by_change_not_by_alphabet(spark, table):
    tasks = table(task(1), task(2))
    rows = [(uid(1), "succeeded", {"a": "old"}, 1), (uid(1), "queued", {"a": "new"}, 2), (uid(1), "succeeded", {"a": "old"}, 1)]
    delta = spark.createDataFrame(rows, "id string, status string, payload map<string,string>, seq long")
    after = {r.id: (r.status, r.payload, r.seq) for r in transitions.apply_transitions(tasks, delta).collect()}
    assert after == {uid(1): ("queued", {"a": "new"}, 2), uid(2): ("queued", {"to": "a@example.com"}, 0)}
    bare = spark.createDataFrame([(uid(1),), (uid(1),)], "id string")
    assert transitions.apply_transitions(tasks, bare).count() == 2


def test_ordinals_survive_storage_and_messages(spark, table, tmp_path):
    tasks = table(task(1))
    moved = transitions.set_status(tasks, spark.createDataFrame([(uid(1), s, i) for i, s in enumerate(("queued", "running", "queued"))], "id string, status string, i int"), AS_OF, order="i")
    tables.append_history(moved.history_delta, str(tmp_path / "log"))
    tables.append_history(log(spark, (1, "failed", -5)), str(tmp_path / "log"))
    stored = tables.read_history(spark, str(tmp_path / "log"))
    assert [r.status for r in H.task_timeline(stored).collect()] == ["failed", "queued", "running", "queued"]
    sent = M.to_history_messages(moved.history_delta).withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("bigint"), "timestamp": F.lit(NOW)})
    good, bad = M.parse_history_messages(sent)
    assert bad.count() == 0 and {tuple(r) for r in good.collect()} == {tuple(r) for r in moved.history_delta.select(*S.LOG_COLUMNS).collect()}
    tables.write_tasks(transitions.apply_transitions(tasks, moved.tasks_delta), str(tmp_path / "tasks"))
    assert one(tables.read_tasks(spark, str(tmp_path / "tasks"))).seq == 3


def test_a_created_task_starts_the_count(spark):
    request = spark.createDataFrame([(uid(1), "x", "noop", {"a": "b"}, 0, 0, 0, None)], "id string, name string, type string, payload map<string,string>, priority int, max_retries int, timeout_seconds int, idempotency_key string")
    made = ingest.create_tasks(request, AS_OF)
    claimed = transitions.claim(made.tasks, 1, AS_OF)
    both = made.history.unionByName(claimed.history_delta)
    assert [(r.status, r.seq) for r in both.orderBy("seq").collect()] == [("queued", 1), ("running", 2)] and H.lifecycle_audit(both).count() == 0


@pytest.mark.parametrize("partitions", [1, 8])
def test_places_do_not_depend_on_the_ranges(spark, partitions):
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"k{rng.randrange(20)}", i * 7919 % 100_003) for i in range(900)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = with_place(spark.createDataFrame(rows, "k string, o int").repartition(partitions), "k", "o", "place").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of_key = defaultdict(list)
    for k, o in rows:
        of_key[k].append(o)
    assert {(r.k, r.o, r.place) for r in got} == {(k, o, i + 1) for k, v in of_key.items() for i, o in enumerate(sorted(v))}
