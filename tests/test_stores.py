"""Bucketed stores, retention of the monthly log and the audit of batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.plans.tick import Store, save_changes, save_tasks
from jobtide.sources import tables
from jobtide.sources.buckets import BucketStore
from jobtide.streaming.audit import audited, read_audit
from jobtide.streaming.sinks import path_exists, subfolders
from tests.test_lifecycle import log, table, task, uid  # noqa: F401  (a fixture)

SCHEMA = "k string, v long, seq long"


def rows(spark, *items):
    return spark.createDataFrame(list(items), SCHEMA)


def test_the_store_is_the_fold_of_its_batches_and_a_batch_may_run_again(spark, tmp_path):
    store = BucketStore(str(tmp_path / "s"), "k", ("seq",), buckets=4, most_parts=2, with_filter=True)
    rng, want = random.Random(1), {}
    for version in range(7):
        batch = {f"k{rng.randrange(25)}": rng.randrange(1000) for _ in range(6)}
        df = rows(spark, *[(k, v, version) for k, v in batch.items()])
        for _ in range(2 if version in (3, 6) else 1):
            store.append(df, version)
        want.update(batch)
        parts = store.parts(spark, version)
        assert max(map(len, parts.values())) <= 2
    got = {r.k: r.v for r in store.read(spark, 6, SCHEMA).collect()}
    assert got == want
    asked = rows(spark, ("k1", 0, 0), ("k1", 1, 1), ("nobody", 0, 0), (None, 0, 0), *[(f"k{i}", 0, 0) for i in range(5, 9)])
    found = {r.k: r.v for r in store.lookup(asked, 6, SCHEMA).collect()}
    assert found == {k: v for k, v in want.items() if k in {"k1", "k5", "k6", "k7", "k8"}}
    # An older version can be read as long as a batch may still need it.
    assert store.read(spark, 5, SCHEMA).count() <= len(want)


def test_what_a_batch_reads_does_not_grow_with_the_history(spark, tmp_path):
    store = BucketStore(str(tmp_path / "s"), "k", ("seq",), buckets=4, most_parts=3, with_filter=True)
    files = []
    for version in range(12):
        store.append(rows(spark, *[(f"k{version}-{i}", i, version) for i in range(8)]), version)
        parts = store.parts(spark, version)
        files.append(sum(map(len, parts.values())))
    assert max(files) <= 4 * 3 and files[-1] <= max(files[:6])
    # Parts that were folded away are gone from the disk, and new keys open no bucket at all.
    on_disk = sum(len(subfolders(spark, f"{tmp_path}/s/{b}")) for b in subfolders(spark, f"{tmp_path}/s"))
    assert on_disk <= 2 * 4 * 3
    assert store.hit_buckets(rows(spark, *[(f"new{i}", 0, 0) for i in range(20)]).select("k"), 11) == []
    assert store.hit_buckets(rows(spark, ("k3-1", 0, 0)).select("k"), 11) != []


def test_an_empty_store_and_empty_batches(spark, tmp_path):
    store = BucketStore(str(tmp_path / "s"), "k", ("seq",), with_filter=True)
    assert store.lookup(rows(spark, ("a", 1, 1)), -1, SCHEMA).count() == 0
    store.append(spark.createDataFrame([], SCHEMA), 0)
    store.append(rows(spark, ("a", 1, 1)), 1)
    store.append(spark.createDataFrame([], SCHEMA), 2)
    assert [r.v for r in store.read(spark, 2, SCHEMA).collect()] == [1] == [r.v for r in store.lookup(rows(spark, ("a", 0, 0)), 2, SCHEMA).collect()]


def test_a_change_writes_to_its_own_buckets_only(spark, table, tmp_path):
    store = Store(str(tmp_path), buckets=16, most_parts=4)
    save_tasks(table(*[task(n) for n in range(200)]), store, 0)
    tasks = store.tasks(spark, 0)
    assert len(store.table().parts(spark, 0)) == 16
    delta = spark.createDataFrame([(uid(3), "running", 1), (uid(8), "failed", 1)], "id string, status string, seq long")
    save_changes(tasks, delta, store, 1)
    assert len(subfolders(spark, f"{tmp_path}/tasks/batch_id=1")) <= 2
    assert spark.read.parquet(f"{tmp_path}/tasks/batch_id=1").count() == 2
    now = {r.id: r.status for r in store.tasks(spark, 1).collect()}
    assert len(now) == 200 and now[uid(3)] == "running" and now[uid(8)] == "failed" and now[uid(4)] == "queued"
    # Filters reach the files of buckets without changes.
    plan = store.tasks(spark, 0).where("status = 'queued'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,queued)" in plan and "Aggregate" not in plan


def test_retention_drops_months_and_rewrites_only_the_cut_one(spark, tmp_path):
    path = str(tmp_path / "log")
    day = 86400
    tables.append_history(log(spark, *[(n, "queued", n * day) for n in (-70, -40, -20, -14, -10, 0, 30)]), path)
    later = spark.read.parquet(f"{path}/event_month=2024-02").inputFiles()
    bound = datetime(2024, 1, 3, 12)
    tables.drop_history_before(spark, path, bound)
    left = {r.occurred_at for r in tables.read_history(spark, path).collect()}
    assert left == {datetime(2024, 1, 15, 12) + timedelta(days=n) for n in (-10, 0, 30)}
    assert subfolders(spark, path) == ["event_month=2024-01", "event_month=2024-02"]
    assert spark.read.parquet(f"{path}/event_month=2024-02").inputFiles() == later
    tables.drop_history_before(spark, path, bound)
    assert tables.read_history(spark, path).count() == 3
    # A run that stopped after it had written the month anew is finished by the next one.
    kept = tables.read_history(spark, path).where("occurred_at >= '2024-01-10'")
    kept.where("occurred_at < '2024-02-01'").coalesce(1).write.parquet(f"{path}/_cut-2024-01")
    tables.drop_history_before(spark, path, "2024-01-10 00:00:00")
    assert tables.read_history(spark, path).count() == 2 and not path_exists(spark, f"{path}/_cut-2024-01")
    tables.drop_history_before(spark, path, "2025-01-01 00:00:00")
    assert subfolders(spark, path) == []


def test_audit_rows_of_good_failed_and_repeated_batches(spark, tmp_path):
    path, seen = str(tmp_path / "audit"), []

    def handle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out")
        seen.append(batch_id)
        if batch_id == 2 and seen.count(2) == 1:
            raise ValueError("no")

    job = audited(handle, path)
    for batch_id in (0, 1, 1):
        job(spark.range(10 * batch_id + 5), batch_id)
    with pytest.raises(ValueError):
        job(spark.range(7), 2)
    job(spark.range(7), 2)
    got = sorted((r.batch_id, r.n, r.status) for r in read_audit(spark, path).collect())
    assert got == [(0, 5, "success"), (1, 15, "success"), (2, 7, "error"), (2, 7, "success")]
    assert read_audit(spark, path).where(F.col("ms") <= 0).count() == 0
    assert audited(handle, None) is handle


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    """A task's share of a large table follows from the number of partitions, not from that of the buckets."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store = BucketStore(str(tmp_path / "t"), "id", ("seq",), buckets=2)
        store.replace(spark.range(1000).selectExpr("CAST(id AS STRING) AS id", "id AS seq"), 0)
        files = [p for p in (tmp_path / "t" / "batch_id=0").glob("bucket=*/part-*")]
        assert len({p.parent.name for p in files}) == 2 and len(files) > 2
        assert store.read(spark, 0, "id string, seq bigint").distinct().count() == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
