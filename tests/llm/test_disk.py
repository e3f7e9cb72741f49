"""What operators leave on disk on their way: a text once, no shuffle files of finished steps, no texts moved without need."""

import random
import re

import pytest

from jobtide.llm import common, jaccard, pii, quality, suffix


def shuffled(spark):
    """Bytes of the shuffle files there are."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in files if f.getName().startswith("shuffle_")}


def prose(n, words=400):
    pick = random.Random(7)
    return [" ".join(str(pick.randrange(10**6)) for _ in range(words)) for _ in range(n)]


@pytest.mark.parametrize("module,work", [(quality, quality.keep_good), (pii, pii.redact)])
def test_a_text_is_settled_once(docs, monkeypatch, module, work):
    seen = []
    monkeypatch.setattr(module, "settle", lambda df: seen.append(df.schema.simpleString()) or common.settle(df))
    df = docs(["Write to jo@example.com or to al@example.com, " + t for t in prose(20, 40)])
    out = work(df)
    assert out.columns == df.columns and out.count() == 20
    assert [found for s in seen if (found := re.findall(r"\b(?:text|_body):string", s))] == [["text:string"]]


def test_a_settled_step_leaves_no_shuffle_files(spark, docs):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(spark), spark.conf.get(name, None)
    df = docs(prose(50)).repartition(4, "doc_id")
    assert common.settle(df).count() == 50
    assert suffix._texts(docs(prose(50)), "text").count() == 50
    left = shuffled(spark)
    assert sum(size for f, size in left.items() if f not in before) < 10_000  # those of the two counts
    assert spark.conf.get(name, None) == setting


def test_texts_that_stay_are_not_moved(spark, docs):
    texts = prose(200)
    df = docs([(i, texts[i % 195]) for i in range(200)] + [(None, texts[0])])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_first(df)
        before = shuffled(spark)
        ids = {r["doc_id"] for r in kept.select("doc_id", "text").collect()}
        moved = sum(size for f, size in shuffled(spark).items() if f not in before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ids == {*range(195), None}
    assert moved < sum(map(len, texts)) / 5
