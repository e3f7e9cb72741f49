"""Decoding messages: spread over the cluster, and done once for all sinks of a batch."""

import json

from jobtide.sources import messages as M
from jobtide.streaming import jobs
from tests.test_streaming import T0, uid


def sent(spark, n):
    rows = [(b"k", json.dumps({"task_id": uid(i), "name": "x"}).encode() if i % 3 else b"{", "t", i % 2, i, T0) for i in range(n)]
    return spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp").coalesce(1)


def test_one_input_partition_is_decoded_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        good, bad = M.parse_task_messages(sent(spark, 90))
        assert good.rdd.getNumPartitions() == bad.rdd.getNumPartitions() == 8
        assert sum(part > 0 for part in good.rdd.glom().map(len).collect()) > 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert good.count() == 60 and bad.count() == 30


def test_all_sinks_of_a_batch_read_what_was_decoded_once(spark, tmp_path, monkeypatch):
    plans, write = [], jobs.write_batch

    def noted(rows, path, *rest):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, path, *rest)

    monkeypatch.setattr(jobs, "write_batch", noted)
    sent(spark, 9).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent(spark, 1).schema).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([(uid(1), "succeeded")], "id string, status string")
    paths = {name: str(tmp_path / name) for name in ("to_run", "skipped", "bad", "checkpoint")}
    jobs.stream_messages(stream, lambda: known, *paths.values()).awaitTermination()
    assert [spark.read.parquet(paths[p]).count() for p in ("to_run", "skipped", "bad")] == [5, 1, 3]
    assert len(plans) == 3 and all("reject_reason" in p.split("InMemoryTableScan", 1)[1].split("\n", 1)[0] for p in plans)
