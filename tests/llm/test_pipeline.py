"""The pipeline against the operators' brute-force counterparts on a small table."""

from pyspark.sql import functions as F

import corpus_pipeline
from jobtide.llm import common
from tests.llm.test_duplicates import classes, shingles


def test_stages_keep_columns_and_their_decisions_hold(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.settle(stage(spark, docs, folder))
        seen[name] = (before, docs)
        if name != "best-fit packing":
            assert docs.columns == columns
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
    before, after = seen["n-gram Jaccard join"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = [shingles(t) for _, t in rows]
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    kept = {rows[c][0] for c in classes(len(rows), linked)}
    assert {r["doc_id"] for r in after.collect()} == kept
    _, clean = seen["PII"]
    assert clean.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    pieces = seen["best-fit packing"][1]
    assert pieces.select("doc_id").distinct().count() == clean.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0
    assert corpus_pipeline.run(spark, folder).count() == pieces.count()
