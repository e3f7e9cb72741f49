"""Operators under one key that holds a third of the rows, against brute force."""

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import history as H
from jobtide.operators import ingest, lookups, metrics, skew
from jobtide.operators.sliced import with_neighbour, with_running_sum

T0 = datetime(2024, 1, 1)
STATUSES = ["queued", "running", "succeeded", "failed", "dead_lettered"]


def make_log(n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        task = "hot" if rng.random() < 0.34 else f"t{rng.randrange(200)}"
        # Ties in time on purpose.
        at = T0 + timedelta(seconds=rng.randrange(0, 40_000) // 5 * 5)
        rows.append((f"{i:06d}", task, rng.choice(STATUSES), at))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    rows = make_log()
    df = spark.createDataFrame(rows, "id string, task_id string, status string, occurred_at timestamp").repartition(4)
    return rows, df


def by_task(rows):
    groups = defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        groups[row[1]].append(row)
    return groups


@pytest.mark.parametrize("slice_seconds", [1, 600, 3600, 10**7])
def test_transitions_do_not_depend_on_the_slices(log, slice_seconds):
    rows, df = log
    want = {}
    for group in by_task(rows).values():
        for before, row, after in zip([None, *group], group, [*group[1:], None]):
            want[row[0]] = (before and before[2], before and before[3], after and after[2], after and after[3])
    back = {r.id: (r.prev_status, r.prev_at) for r in H.transitions(df, slice_seconds).collect()}
    ahead = {r.id: (r.next_status, r.next_at) for r in H.next_transitions(df, slice_seconds).collect()}
    assert {k: (*back[k], *ahead[k]) for k in back} == want


@pytest.mark.parametrize("slice_seconds", [1, 3600, 10**7])
def test_attempts_and_cycles(log, slice_seconds):
    rows, df = log
    want = {}
    for group in by_task(rows).values():
        cycle = attempt = 0
        for row in group:
            attempt += row[2] == "running"
            want[row[0]] = (cycle, attempt)
            if row[2] in ("succeeded", "failed", "dead_lettered"):
                cycle, attempt = cycle + 1, 0
    assert {r.id: (r.cycle, r.attempt) for r in H.attempts(df, slice_seconds).collect()} == want


def test_slices_spread_the_hot_key(log):
    """No (key, slice) group comes near the hot key's share of the rows."""
    from jobtide.operators.sliced import with_slice

    _, df = log
    sizes = with_slice(df, "occurred_at", 3600).groupBy("task_id", "_slice").count().agg(F.max("count")).first()[0]
    whole = df.groupBy("task_id").count().agg(F.max("count")).first()[0]
    assert sizes * 5 < whole


def test_running_sum_exclusive_and_inclusive(spark):
    rows = [("k", T0 + timedelta(hours=i), i, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, v int")
    for inclusive in (True, False):
        got = {r.i: r.s for r in with_running_sum(df, ["k"], "at", "i", F.col("v"), "s", inclusive).collect()}
        assert got == {i: sum(range(i + (1 if inclusive else 0))) for i in range(50)}


def test_neighbour_keeps_all_columns_and_rows(spark):
    df = spark.createDataFrame([("k", T0, 1, "x"), ("k", T0, 2, None)], "k string, at timestamp, i int, extra string")
    got = with_neighbour(df, ["k"], "at", "i", {"before": "extra"}).orderBy("i").collect()
    assert [(r.i, r.extra, r.before) for r in got] == [(1, "x", None), (2, None, "x")]


@pytest.mark.parametrize("hot_rows,max_hot", [(1_000_000, 10_000), (100, 10_000), (0, 1), (0, 10_000)])
def test_lookup_is_the_same_whatever_counts_as_hot(spark, hot_rows, max_hot):
    rng = random.Random(2)
    keys = [None if rng.random() < 0.2 else ("hot" if rng.random() < 0.5 else f"k{rng.randrange(300)}") for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id int, key string").repartition(3)
    known = sorted({k for k in keys if k and k != "k7"})
    lookup = spark.createDataFrame([(k, f"v-{k}", keys.count(k)) for k in known], "key string, v string, n bigint")
    got = skew.lookup_by_key(rows, lookup, "key", "id", hot_rows=hot_rows, max_hot=max_hot)
    assert got.columns == ["id", "key", "v"]
    assert {r.id: r.v for r in got.collect()} == {i: f"v-{k}" if k in known else None for i, k in enumerate(keys)}


def test_hot_rows_do_not_meet_in_one_partition(spark):
    """With broadcasts off for the cold side, the rows of a hot key and the rows without a key fan out."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).select("id", F.expr("CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 4 = 1 THEN concat('k', id) END AS key"))
        lookup = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("v"))
        joined = skew.lookup_by_key(rows, lookup, "key", "id", hot_rows=1000)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_idempotency_with_a_hot_key_and_many_blank_ones(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot", "hot", None, f"k{rng.randrange(50)}"]), rng.randrange(10)) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, idempotency_key string, rank int").repartition(5)
    stored = spark.createDataFrame([(-1, "k1"), (-2, None), (-3, "other")], "id int, idempotency_key string")
    first = {}
    for i, key, rank in sorted(rows, key=lambda r: (r[2], r[0])):
        first.setdefault(key, i)
    first["k1"] = -1
    want = {i: i if key is None else first[key] for i, key, _ in rows}
    for prune in (False, True):
        got = ingest.resolve_idempotency(df, stored, ["rank"], prune_stored=prune).collect()
        assert {r.id: r.task_id for r in got} == want
        assert all((r.outcome == "CREATED") == (r.id == r.task_id) for r in got)


def nearest_rank(values, p):
    values = sorted(values)
    return values[min(max(math.ceil(len(values) * p / 100) - 1, 0), len(values) - 1)]


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_percentiles_are_exact_even_with_poor_cuts(spark, accuracy):
    rng = random.Random(4)
    data = [("hot", rng.lognormvariate(0, 3)) for _ in range(4000)] + [("flat", 1.0)] * 500
    data += [("few", 5.0), ("few", 7.0), (None, 3.0), ("none", None)]
    df = spark.createDataFrame(data, "kind string, v double").repartition(4)
    got = {r.kind: r for r in metrics.latency_percentiles(df, "v", ["kind"], whole_ms=False, accuracy=accuracy).collect()}
    groups = defaultdict(list)
    for kind, v in data:
        if v is not None:
            groups[kind].append(v)
    assert set(got) == set(groups)
    for kind, values in groups.items():
        row = got[kind]
        assert row.n == len(values)
        assert [row.p50, row.p95, row.p99, row.p999] == [nearest_rank(values, p) for p in (50, 95, 99, 99.9)]


@pytest.mark.parametrize("cell_rows", [1, 7, 300])
def test_percentiles_narrow_down_to_small_cells(spark, cell_rows):
    """Ties at either end, one value in most rows, far-off values: cells shrink until they are small or hold one value."""
    rng = random.Random(6)
    data = [("low", 0.0)] * 900 + [("low", rng.random()) for _ in range(100)]
    data += [("high", 5.0)] * 900 + [("high", 5.0 - rng.random()) for _ in range(100)]
    data += [("wide", math.exp(rng.uniform(-300, 300)) * rng.choice([1, -1])) for _ in range(700)] + [("one", 2.5)] * 400 + [("two", float(i % 2)) for i in range(400)]
    df = spark.createDataFrame(data, "kind string, v double").repartition(4)
    got = {r.kind: r for r in metrics.latency_percentiles(df, "v", ["kind"], whole_ms=False, accuracy=50, cell_rows=cell_rows).collect()}
    for kind in ("low", "high", "wide", "one", "two"):
        values = [v for k, v in data if k == kind]
        assert [got[kind].n, got[kind].p50, got[kind].p95, got[kind].p99, got[kind].p999] == [len(values), *(nearest_rank(values, p) for p in (50, 95, 99, 99.9))]
    whole = metrics.latency_percentiles(df, "v", whole_ms=False, accuracy=50, cell_rows=cell_rows).first()
    assert whole.p95 == nearest_rank([v for _, v in data], 95)


def test_percentiles_of_many_groups(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("string").alias("kind"), F.col("id").cast("double").alias("v"))
    got = {r.kind: r.p50 for r in metrics.latency_percentiles(df, "v", ["kind"], whole_ms=False).collect()}
    assert got == {str(k): float(k + 20 * 9) for k in range(20)}


def test_percentiles_of_nothing_are_zero(spark):
    row = metrics.latency_percentiles(spark.createDataFrame([], "v double"), "v").collect()
    assert [tuple(r) for r in row] == [(0, 0.0, 0.0, 0.0, 0.0)]


def test_history_for_by_broadcast_and_by_shuffle(spark, log):
    rows, df = log
    tasks = spark.createDataFrame([("hot",), ("t1",), ("silent",)], "id string")
    ids = spark.createDataFrame([("hot",), ("t1",), ("silent",), ("t2",), ("t2",)], "id string")
    want = {(r[1], True, r[0]) for r in rows if r[1] in ("hot", "t1")} | {("silent", True, None), ("t2", False, None)}
    for limit in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            got = lookups.history_for(df, tasks, ids).collect()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert {(r.task_id, r.task_exists, r.id) for r in got} == want and len(got) == len(want)
