"""The outbox as a log: order, failures, restarts and pruning."""

import json
from datetime import timedelta

import pytest

from jobtide import schemas as S
from jobtide.streaming.outbox import OutboxLog
from jobtide.streaming.sinks import subfolders
from tests.test_streaming import T0, uid

AS_OF = "2024-01-01 12:00:00"


def box(spark, *numbers):
    """Rows with falling numbers in time, some with one instant."""
    rows = [(f"o{n:03d}", uid(n), json.dumps({"task_id": uid(n)}), T0 + timedelta(seconds=n // 2), None) for n in numbers]
    return spark.createDataFrame([*rows, ("sent", uid(0), "{}", T0, T0)], S.OUTBOX).repartition(3)


class Topic:
    def __init__(self, fail_at=None):
        self.got, self.calls, self.fail_at = [], [], fail_at

    def __call__(self, rows, batch_id, number):
        self.calls.append((batch_id, number))
        if self.fail_at == len(self.calls):
            raise ConnectionError("away")
        self.got += [r.id for r in rows.orderBy("created_at", "id").collect()]


def names(*numbers):
    return [f"o{n:03d}" for n in numbers]


def test_rows_go_out_in_order_and_stop_at_the_first_failure(spark, tmp_path):
    log, topic = OutboxLog(str(tmp_path / "published"), range_rows=4), Topic(fail_at=3)
    log.publish(box(spark, *range(19, -1, -1)), 0, topic, AS_OF)
    assert topic.got == names(*range(8)) and log.unsent(spark, 0) == [2, 3, 4]
    # The next batch sends the rest first where it is older, and everything in one order.
    topic.fail_at = None
    log.publish(box(spark, 30, 25, 9), 1, topic, AS_OF)
    assert topic.got == names(*range(9), 9, 9, *range(10, 20), 25, 30) and log.unsent(spark, 1) == []
    assert sorted(r.id for r in spark.read.parquet(log.published).collect()) == sorted(topic.got)
    log.publish(box(spark), 2, topic, AS_OF)
    assert len(topic.got) == 23


def test_a_batch_that_is_run_again_takes_up_where_it_stopped(spark, tmp_path):
    log, topic = OutboxLog(str(tmp_path / "published"), range_rows=5), Topic(fail_at=2)
    batch = box(spark, *range(12))
    log.publish(batch, 0, topic, AS_OF)
    log.publish(batch, 0, topic, AS_OF)
    assert topic.calls == [(0, 0), (0, 1), (0, 1), (0, 2)] and topic.got == names(*range(12))


@pytest.mark.parametrize("keep,left", [(3600, ["batch_id=2", "batch_id=3", "batch_id=4"]), (10**6, [f"batch_id={n}" for n in range(5)])])
def test_old_marks_and_plans_leave_the_disk(spark, tmp_path, keep, left):
    log, topic = OutboxLog(str(tmp_path / "published"), keep_seconds=keep), Topic()
    for n in range(5):
        log.publish(box(spark, n), n, topic, f"2024-01-01 {10 + n}:00:00" if n < 3 else "2024-01-01 12:59:59")
    assert subfolders(spark, log.published) == left
    assert subfolders(spark, f"{log.published}_waiting") == ["batch_id=3", "batch_id=4"]
    assert topic.got == names(*range(5))


def test_many_short_ranges_go_in_few_sendings(spark, tmp_path):
    log, topic = OutboxLog(str(tmp_path / "published"), range_rows=2), Topic()
    log.publish(box(spark, *range(199, -1, -1)), 0, topic, AS_OF)
    assert topic.got == names(*range(200)) and log.unsent(spark, 0) == []
    assert topic.calls == [(0, n) for n in (0, 1, 2, 3, 4, 6, 10, 18, 34, 66)]
    assert len(subfolders(spark, f"{log.published}_waiting/batch_id=0")) == 1


def test_a_range_that_cannot_be_sent_among_others_holds_back_only_what_follows(spark, tmp_path):
    log, got, tried = OutboxLog(str(tmp_path / "published"), range_rows=2), [], []

    def send(rows, batch_id, number):
        ids = [r.id for r in rows.orderBy("created_at", "id").collect()]
        tried.append(len(ids))
        if "o041" in ids and not batch_id:
            raise ConnectionError("away")
        got.extend(ids)

    log.publish(box(spark, *range(100)), 0, send, AS_OF)
    assert got == names(*range(40)) and log.unsent(spark, 0) == list(range(20, 50)) and tried[-1] == 2
    # Run again, it begins at the same range; the next batch takes over the rest.
    tried.clear()
    log.publish(box(spark, *range(100)), 0, send, AS_OF)
    assert got == names(*range(40)) and tried == [2]
    log.publish(box(spark, 3), 1, send, AS_OF)
    assert got == names(*range(40), 3, *range(40, 100)) and log.unsent(spark, 1) == []
    assert sorted(r.id for r in spark.read.parquet(log.published).collect()) == sorted(got)


def test_a_mark_that_was_cut_short_is_no_mark(spark, tmp_path):
    log, topic = OutboxLog(str(tmp_path / "published"), range_rows=2), Topic(fail_at=3)
    log.publish(box(spark, *range(10)), 0, topic, AS_OF)
    spark.range(1).selectExpr("'o009' id", "timestamp'2024-01-01' published_at").write.parquet(f"{log.published}/batch_id=0/range=3")
    (tmp_path / "published" / "batch_id=0" / "range=3" / "_SUCCESS").unlink()
    assert log.unsent(spark, 0) == [2, 3, 4]
    log.publish(box(spark, *range(10)), 0, topic, AS_OF)
    assert topic.got == names(*range(10))
    assert sorted(r.id for r in spark.read.parquet(log.published).collect()) == names(*range(10))
