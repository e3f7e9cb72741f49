"""A record of every batch that a streaming job handled: how many rows, how long it took, how it ended."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

AUDIT = "batch_id bigint, attempt string, n bigint, ms double, status string"
Handler = Callable[[DataFrame, int], None]


def audited(handle: Handler, path: str | None) -> Handler:
    """``handle`` with a row ``(batch_id, attempt, n, ms, status)`` in ``path`` for each time it is called. The rows of a batch are
    counted as they pass, by an observed metric, so nothing is read twice; only a batch that failed is counted
    on its own. Without a path, ``handle`` as it is."""
    if path is None:
        return handle

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, attempt = batch.sparkSession, uuid.uuid4().hex
        seen = Observation(f"batch {batch_id} {attempt}")
        began = time.monotonic()

        def note(n: int | None, status: str) -> None:
            row = (batch_id, attempt, n, (time.monotonic() - began) * 1000.0, status)
            spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(path)

        try:
            handle(batch.observe(seen, F.count(F.lit(1)).alias("n")), batch_id)
        except Exception:
            note(batch.count(), "error")
            raise
        note(seen.get["n"], "success")

    return run


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Every failed attempt, and one success per batch: one that was run again after its success counts once."""
    rows = spark.read.schema(AUDIT).parquet(path)
    done = rows.where(F.col("status") == "success").groupBy("batch_id", "status")
    done = done.agg(F.max(F.struct("ms", "attempt", "n")).alias("r")).select("batch_id", "r.attempt", "r.n", "r.ms", "status")
    return done.unionByName(rows.where(F.col("status") != "success"))
