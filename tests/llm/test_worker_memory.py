"""What Python workers and the JVM hold: one operator's cache at a time, and Arrow batches bounded in bytes."""

import gc
import weakref

import pyarrow as pa

from jobtide.llm import common, jaccard, packing
from jobtide.llm.queries import WORD_BPE

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


class Owner:
    def __init__(self):
        self.known = common.TextMemo(self.find)

    def find(self, key):
        return len(key)


def test_a_cache_that_is_a_cycle_goes_when_another_is_asked_for():
    gc.disable()
    try:
        held = weakref.ref(common.worker_cache("first of two", Owner))
        assert held().known["ab"] == 2 and common.worker_cache("first of two", Owner) is held()
        common.worker_cache("second of two", dict)
        assert held() is None
    finally:
        gc.enable()


def test_batches_are_bounded_in_bytes(spark, docs):
    before = spark.conf.get(NAME, None)
    df = docs(["x" * 1_000] * 200).coalesce(1).select("text")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows])], ["n"])

    with common.small_batches(spark, 20_000):
        found = [r["n"] for r in df.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 200 and max(found) <= 25
    assert spark.conf.get(NAME, None) == before


def test_join_and_packing_ask_for_bounded_batches(spark, docs, monkeypatch):
    limits = []
    for module in (jaccard, packing):
        monkeypatch.setattr(module, "settle", lambda df: limits.append(int(spark.conf.get(NAME))) or common.settle(df))
    df = docs(["a b c d e f g h i j", "a b c d e f g h i j", "k l m n o p"])
    assert jaccard.near_duplicates(df).count() == 3
    pieces = packing.pack_documents(df, WORD_BPE)
    assert pieces.count() == 3 and len(limits) > 10 and set(limits) == {common.TOGETHER}
