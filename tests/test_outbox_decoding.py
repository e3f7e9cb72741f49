"""Outbox rows are decoded once, however many ranges they make and however often they wait."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.streaming import jobs
from tests.test_outbox_log import box
from tests.test_streaming import uid


@pytest.mark.parametrize("plain", [False, True])
def test_rows_are_decoded_once(spark, tmp_path, monkeypatch, plain):
    decoded, calls, got = [], [], []
    read = jobs.M.read_outbox_payloads
    monkeypatch.setattr(jobs.M, "read_outbox_payloads", lambda rows: decoded.append(sorted(r.id for r in rows.select("id").collect())) or read(rows))
    source, *paths = (str(tmp_path / p) for p in ("in", "topic", "published", "quarantine", "checkpoint"))

    def run(*numbers, away=None):
        def send(messages, batch, number):
            calls.append(number)
            if len(calls) == away:
                raise ConnectionError("away")
            got.extend(json.loads(r.value)["task_id"] for r in messages.collect())

        rows = box(spark, *numbers).withColumn("payload", F.expr("CASE WHEN id = 'o004' THEN '{no' ELSE payload END"))
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.OUTBOX).parquet(source)
        jobs.stream_outbox(stream, *paths, lambda: "2024-01-01 12:00:00", send=send, range_rows=2).awaitTermination()

    run(*range(12), away=4)
    assert decoded == [[f"o{n:03d}" for n in range(12)]]
    assert got == [uid(n) for n in (0, 1, 2, 3, 5)]
    if plain:  # what waits was written by a version that did not decode ahead
        waiting = tmp_path / "published_waiting" / "batch_id=0"
        rows = spark.read.parquet(str(waiting))
        rows.selectExpr("id", "raw_task_id task_id", "raw_payload payload", "created_at", "range", "block").write.partitionBy("block").parquet(f"{waiting}_old")
        shutil.rmtree(waiting)
        (tmp_path / "published_waiting" / "batch_id=0_old").rename(waiting)
    run(12, 13)
    rest = [[f"o{n:03d}" for n in range(6, 12)]] if plain else []
    assert decoded == [[f"o{n:03d}" for n in range(12)], ["o012", "o013"], *rest]
    assert got == [uid(n) for n in (0, 1, 2, 3, 5, *range(6, 14))]
    bad = spark.read.parquet(paths[2])
    assert [(r.id, r.payload) for r in bad.collect()] == [("o004", "{no")]
