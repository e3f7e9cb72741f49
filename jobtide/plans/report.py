"""The load report: what was created, how fast, and what became of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators import metrics


def _long(row: DataFrame, section: str, measures: dict[str, str | Column]) -> DataFrame:
    """One-row frame to ``section, measure, value`` rows."""
    pairs = [
        F.struct(F.lit(name).alias("measure"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("value"))
        for name, v in measures.items()
    ]
    return row.select(F.lit(section).alias("section"), F.explode(F.array(*pairs)).alias("m")).select(
        "section", "m.measure", "m.value"
    )


def load_report(samples: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """``section, measure, value``.

    ``samples``: one row per create call, ``created_at, error, latency_seconds``. ``finished``: the tasks
    that were watched, ``status, e2e_seconds, finished_at``; without it the report covers creation only.
    Percentiles of creation are over the calls that went well, those of the end over finished tasks.
    """
    shares = ("p50", "p95", "p99", "p999")
    worked = samples.where(F.coalesce(F.col("error"), F.lit("")) == "")
    calls = metrics.error_rate(samples)
    parts = [
        _long(calls, "create", {"created": F.col("total") - F.col("errors"), "errors": "errors", "error_rate": "error_rate"}),
        _long(metrics.latency_percentiles(worked, "latency_seconds"), "create_latency", {p: p for p in shares}),
        _long(metrics.throughput(worked, "created_at"), "create_rate", {"per_second": "per_second"}),
    ]
    if finished is not None:
        done = finished.where(F.col("status").isin("succeeded", "failed", "dead_lettered"))
        summary = metrics.completion_summary(finished)
        parts += [
            _long(summary, "finish", {c: c for c in ("completed", "failed", "stuck")}),
            _long(metrics.latency_percentiles(done, "e2e_seconds"), "finish_latency", {p: p for p in shares}),
            _long(metrics.throughput(done, "finished_at"), "finish_rate", {"per_second": "per_second"}),
        ]
    return reduce(lambda a, b: a.unionByName(b), parts)
