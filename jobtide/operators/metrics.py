"""Counts, depths, rates, percentiles and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide import schemas as S
from jobtide.functions.scalars import col, is_terminal, micros, route_pattern, severity, truncate_ms
from jobtide.operators.dispatch import outbox_pending
from jobtide.operators.history import transitions
from jobtide.operators.skew import settled
from jobtide.operators.sliced import with_running_sum, with_running_sums

#: Seconds of a series that are summed in one task; there is one row per so many seconds in the window over all of it.
SERIES_SLICE = 30 * 86_400



def counts(df: DataFrame, *by: str | Column, name: str = "n") -> DataFrame:
    """Rows per group; partial counts leave the map side, so a group of any size is one row per task."""
    return df.groupBy(*[col(c) for c in by]).agg(F.count("*").alias(name))


def outbox_depth(outbox: DataFrame) -> DataFrame:
    return outbox_pending(outbox).agg(F.count("*").alias("depth"))


def dlq_depth(dlq: DataFrame) -> DataFrame:
    """Row count; 0 for an empty table."""
    return dlq.agg(F.count("*").alias("depth"))


def in_progress(tasks: DataFrame) -> DataFrame:
    return tasks.agg(F.count_if(F.col("status") == S.RUNNING).alias("in_progress"))


def depth_series(changes: DataFrame, ts: str, delta: str, step: str) -> DataFrame:
    """``step_start, delta, depth``: net change per step, then a running total over the steps that have one.

    Per-step totals are summed inside slices of time; only one row per slice meets in one place.
    """
    steps = changes.groupBy(F.window(ts, step)["start"].alias("step_start")).agg(F.sum(delta).alias("delta"))
    return with_running_sum(steps, [], "step_start", "step_start", F.col("delta"), "depth", slice_seconds=SERIES_SLICE)


def _gauge(history: DataFrame, up: Column, down: Column, step: str) -> DataFrame:
    change = up.cast("int") - F.coalesce(down, F.lit(False)).cast("int")
    moves = transitions(history).withColumn("change", change).where("change <> 0")
    return depth_series(moves, "occurred_at", "change", step)


def dlq_depth_series(history: DataFrame, step: str = "1 hour") -> DataFrame:
    """+1 for every dead letter, -1 when a dead letter goes back to the queue."""
    dead = F.col("status") == S.DEAD_LETTERED
    back = (F.col("prev_status") == S.DEAD_LETTERED) & (F.col("status") == S.QUEUED)
    return _gauge(history, dead, back, step)


def in_progress_series(history: DataFrame, step: str = "1 hour") -> DataFrame:
    """+1 when a run starts, -1 at whatever follows it."""
    return _gauge(history, F.col("status") == S.RUNNING, F.col("prev_status") == S.RUNNING, step)


def created_by_type(outcomes: DataFrame, batch: Column | None = None) -> DataFrame:
    """Created rows per type; batch requests share the label ``batch``; repeats of a key do not count."""
    label = F.col("type") if batch is None else F.when(batch, "batch").otherwise(F.col("type"))
    return counts(outcomes.where(F.col("outcome") == "CREATED"), label.alias("type"), name="created")


def processed_by_type_status(routed: DataFrame) -> DataFrame:
    """Runs per type and outcome. Tasks without a handler are not counted."""
    ran = routed.where(F.col("outcome").isin(S.SUCCEEDED, "retry", S.DEAD_LETTERED))
    return counts(ran, "type", F.col("outcome").alias("status"), name="processed")


def reap_counts(plan: DataFrame) -> DataFrame:
    """Both outcomes, zero rows included."""
    totals = plan.agg(
        F.count_if(F.col("outcome") == "requeued").alias("requeued"),
        F.count_if(F.col("outcome") == S.DEAD_LETTERED).alias(S.DEAD_LETTERED),
    )
    return totals.unpivot([], ["requeued", S.DEAD_LETTERED], "outcome", "n")


def requests_by_route(log: DataFrame) -> DataFrame:
    """``log``: method, path, status and, where the router knew it, ``route``."""
    known = F.coalesce(F.nullif(F.col("route"), F.lit("")), F.col("path")) if "route" in log.columns else route_pattern("path")
    return counts(log, "method", known.alias("route"), "status", name="requests")


def severity_counts(log: DataFrame) -> DataFrame:
    return counts(log, severity("status").alias("severity"), name="requests")


def status_breakdown(tasks: DataFrame) -> DataFrame:
    return counts(tasks, "status").orderBy("status")


def terminal_counts(tasks: DataFrame) -> DataFrame:
    return counts(tasks, "status", is_terminal("status").alias("terminal"))


def completion_summary(tasks: DataFrame) -> DataFrame:
    done = F.col("status") == S.SUCCEEDED
    failed = F.col("status").isin(S.FAILED, S.DEAD_LETTERED)
    return tasks.agg(
        F.count_if(done).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.count_if(~(done | failed) | F.col("status").isNull()).alias("stuck"),
    )


def error_rate(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``error`` NULL or empty means success. No rows: NULL rate."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    totals = samples.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(failed).alias("errors"))
    return totals.withColumn("error_rate", 100.0 * F.col("errors") / F.nullif(F.col("total"), F.lit(0)))


def throughput(samples: DataFrame, ts: str, counted: Column | None = None) -> DataFrame:
    """Counted rows per second of the span they all cover; NULL for a span of zero."""
    hits = F.count("*") if counted is None else F.count_if(counted)
    span = (F.max(micros(ts)) - F.min(micros(ts))) / F.lit(1_000_000.0)
    totals = samples.agg(hits.alias("n"), span.alias("span_seconds"))
    return totals.withColumn("per_second", F.col("n") / F.nullif(F.col("span_seconds"), F.lit(0.0)))


#: Rows whose values one task counts one by one when it looks for a percentile.
CELL_ROWS = 1_000_000


def percentile_label(p: float) -> str:
    return "p" + f"{p:g}".replace(".", "")


def _narrowed(inside: DataFrame, targets: DataFrame, cell_rows: int, accuracy: int) -> tuple[DataFrame, DataFrame]:
    """``inside`` (``_g, cut, _v``) and ``targets`` (``_g, cut, p, nth``) with cuts of at most ``cell_rows`` rows or one value.

    Each round takes quantiles of the cuts that are still too large and parts their rows at them: those below, at and
    between the quantiles, which are values that occur. So every round sets a value apart from others, ties end in a
    cell of their own, and what lies between shrinks to a sixteenth or so."""
    grid = [i / 16 for i in range(1, 16)]
    while True:
        shape = [F.count("*").alias("rows"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.percentile_approx("_v", grid, accuracy).alias("at")]
        large = settled(inside.groupBy("_g", "cut").agg(*shape).where((F.col("rows") > cell_rows) & (F.col("low") < F.col("high"))).select("_g", "cut", "at"))
        if large.isEmpty():
            return inside, targets
        inside, targets = settled(inside), settled(targets)
        steps = [(F.col("_v") > F.col("at")[i]).cast("int") + (F.col("_v") >= F.col("at")[i]).cast("int") for i in range(len(grid))]
        cells = inside.join(large, ["_g", "cut"]).select("_g", "cut", "_v", reduce(lambda a, b: a + b, steps).alias("step"))
        upto = Window.partitionBy("_g", "cut").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = cells.groupBy("_g", "cut", "step").agg(F.count("*").alias("rows")).withColumn("seen", F.sum("rows").over(upto))
        # An open cell has as many steps as it has quantiles on either side: at most 31 for each cut.
        here = targets.join(counted, ["_g", "cut"]).where((F.col("nth") <= F.col("seen")) & (F.col("nth") > F.col("seen") - F.col("rows")))
        part = F.concat_ws(".", "cut", F.col("step").cast("string")).alias("cut")
        found = settled(here.select("_g", part, "p", (F.col("nth") - F.col("seen") + F.col("rows")).alias("nth")))
        rest = large.select("_g", "cut")
        parted = cells.select("_g", part, "_v").join(found.select("_g", "cut").distinct(), ["_g", "cut"], "left_semi")
        inside = settled(inside.join(rest, ["_g", "cut"], "left_anti").select("_g", "cut", "_v").unionByName(parted))
        targets = settled(targets.join(rest, ["_g", "cut"], "left_anti").select("_g", "cut", "p", "nth").unionByName(found))


def latency_percentiles(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    percentiles: tuple[float, ...] = (50, 95, 99, 99.9),
    whole_ms: bool = True,
    accuracy: int = 10_000,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Exact nearest-rank percentiles, one column each, plus ``n``.

    The values are settled once. Sketches only propose where to look: each group is cut at values a little below and
    above every wanted rank, and rows per cut are counted exactly, for all percentiles at once. A cut that holds a wanted
    rank is cut again until it has at most ``cell_rows`` rows or a single value (``_narrowed``); only then are its values
    counted one by one. A poor proposal makes another round, never a wrong result or a large task.
    """
    keys = by or []
    label = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    rows = settled(df.where(F.col(value).isNotNull()).select(label.alias("_g"), F.col(value).cast("double").alias("_v"), *keys))
    reach = 2.0 / accuracy
    probes = sorted({min(max(p / 100 + d, 0.0), 1.0) for p in percentiles for d in (-reach, reach)})
    stats = rows.groupBy("_g").agg(
        F.count("*").alias("n"),
        F.percentile_approx("_v", probes, accuracy).alias("cuts"),
        *[F.first(k).alias(k) for k in keys],
    )
    # Cuts may come out differently each time they are computed, and they are used more than once.
    stats = settled(stats)
    # Without groups there is one row of them, which goes into the plan as literals and needs no join.
    whole = stats.head() if not keys else None

    def beside(df: DataFrame, column: str) -> DataFrame:
        if keys:
            return df.join(stats.select("_g", column), "_g")
        if column == "n":
            return df.withColumn("n", F.lit(whole["n"] if whole else 0).cast("bigint"))
        return df.withColumn("cuts", F.array(*[F.lit(c).cast("double") for c in (whole["cuts"] if whole else [None] * len(probes))]))

    narrow = rows.select("_g", "_v")
    placed = beside(narrow, "cuts")
    above = [(F.col("_v") > F.col("cuts")[i]).cast("int") for i in range(len(probes))]
    placed = placed.select("_g", "_v", reduce(lambda a, b: a + b, above).alias("cut"))

    per_cut = beside(placed.groupBy("_g", "cut").agg(F.count("*").alias("rows")), "n")
    upto = Window.partitionBy("_g").orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = F.explode(
        F.array(
            *[
                F.struct(F.lit(float(p)).alias("p"), F.greatest(F.ceil(F.col("n") * F.lit(float(p)) / 100), F.lit(1)).alias("rank"))
                for p in percentiles
            ]
        )
    )
    targets = (
        per_cut.withColumn("seen", F.sum("rows").over(upto))
        .select("_g", "cut", "seen", "rows", ranks.alias("want"))
        .where((F.col("want.rank") <= F.col("seen")) & (F.col("want.rank") > F.col("seen") - F.col("rows")))
        .select("_g", "cut", "want.p", (F.col("want.rank") - F.col("seen") + F.col("rows")).alias("nth"), "rows")
    )
    targets = settled(targets)
    too_large = not targets.where(F.col("rows") > cell_rows).isEmpty()
    targets = targets.drop("rows")
    # At most one cut per percentile and group. Looked up by group, so that rows of a busy group's other cuts
    # do not travel to one place just to be dropped there.
    if keys:
        wanted = targets.groupBy("_g").agg(F.collect_set("cut").alias("wanted"))
        inside = placed.join(settled(wanted), "_g").where(F.array_contains("wanted", F.col("cut"))).drop("wanted")
    else:
        inside = placed.where(F.col("cut").isin([r["cut"] for r in targets.select("cut").distinct().collect()]))
    if too_large:
        named = lambda rows: rows.withColumn("cut", F.col("cut").cast("string"))
        inside, targets = _narrowed(named(inside), named(targets), cell_rows, accuracy)
    values = inside.groupBy("_g", "cut", "_v").agg(F.count("*").alias("rows"))
    upto = Window.partitionBy("_g", "cut").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = values.withColumn("seen", F.sum("rows").over(upto))
    hits = values.join(targets, ["_g", "cut"]).where(
        (F.col("nth") <= F.col("seen")) & (F.col("nth") > F.col("seen") - F.col("rows"))
    )
    picked = hits.groupBy("_g").agg(
        *[F.max(F.when(F.col("p") == float(p), F.col("_v"))).alias(percentile_label(p)) for p in percentiles]
    )
    labels = [percentile_label(p) for p in percentiles]
    if keys:
        result = stats.select("_g", *keys, "n").join(picked, "_g", "left")
    else:  # no rows at all still give one row, of zeros
        result = beside(picked, "n").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("n", *labels)])
    cut = truncate_ms if whole_ms else F.col
    return result.select(*keys, "n", *[cut(c).alias(c) for c in labels])


def bucket_counts(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str | Column]) -> DataFrame:
    """One row per group: ``cumulative`` (rows at or below each bound), ``total``, ``value_sum``. One pass,
    one fixed-size buffer per group."""
    marks = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    wide = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        *marks, F.count("*").alias("total"), F.sum(value).cast("double").alias("value_sum")
    )
    kept = [c for c in wide.columns if c not in {f"b{i}" for i in range(len(bounds))}]
    return wide.select(*kept, F.array(*[f"b{i}" for i in range(len(bounds))]).alias("cumulative"))


def quantile_of(cumulative: Column, total: Column, bounds: tuple[float, ...], q: float) -> Column:
    """Quantile by straight-line interpolation inside the first bucket that reaches the rank: from 0 in
    the first bucket, the highest bound when none reaches it, NULL without rows."""
    rank = F.lit(float(q)) * total
    result = F.when(total == 0, None)
    for i, bound in enumerate(bounds):
        low, before = (bounds[i - 1], cumulative[i - 1]) if i else (0.0, F.lit(0))
        share = (rank - before) / F.nullif((cumulative[i] - before).cast("double"), F.lit(0.0))
        result = result.when(cumulative[i] >= rank, F.lit(low) + F.lit(bound - low) * share)
    return result.otherwise(F.lit(bounds[-1]))


def histogram(df: DataFrame, value: str, bounds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """``by, le, cumulative, total, value_sum``, one row per bound; the last bound is infinity."""
    keys = by or []
    wide = bucket_counts(df, value, bounds, keys)
    steps = [F.struct(F.lit(float(b)).alias("le"), F.col("cumulative")[i].alias("upto")) for i, b in enumerate(bounds)]
    steps.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("upto")))
    return wide.select(*keys, F.explode(F.array(*steps)).alias("s"), "total", "value_sum").select(
        *keys, "s.le", F.col("s.upto").alias("cumulative"), "total", "value_sum"
    )


def histogram_quantile(hist: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """Quantile of a stored histogram in long form, at most one row per bound and group."""
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("le")
    steps = hist.withColumns(
        {
            "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "before": F.coalesce(F.lag("cumulative").over(order), F.lit(0)),
            "rank": F.lit(float(q)) * F.col("total"),
        }
    )
    reached = F.when(F.col("cumulative") >= F.col("rank"), F.struct("le", "low", "before", "cumulative", "rank"))
    first = steps.groupBy(*keys).agg(F.min(reached).alias("f"), F.max("total").alias("total"))
    share = (F.col("f.rank") - F.col("f.before")) / F.nullif((F.col("f.cumulative") - F.col("f.before")).cast("double"), F.lit(0.0))
    inside = F.col("f.low") + (F.col("f.le") - F.col("f.low")) * share
    quantile = F.when(F.col("total") == 0, None).when(F.col("f.le") == float("inf"), F.col("f.low")).otherwise(inside)
    return first.select(*keys, quantile.alias("quantile"))


def value_quantile(
    df: DataFrame, value: str, bounds: tuple[float, ...], q: float, by: list[str] | None = None
) -> DataFrame:
    """Histogram quantile straight from rows: one aggregate, the rest is an expression."""
    wide = bucket_counts(df, value, bounds, by or [])
    return wide.select(*(by or []), quantile_of(F.col("cumulative"), F.col("total"), bounds, q).alias("quantile"))


def event_rate(df: DataFrame, ts: str, by: list[str], seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows."""
    window = F.window(ts, f"{seconds} seconds")["start"].alias("window_start")
    return counts(df, window, *by, name="events").withColumn("per_second", F.col("events") / F.lit(float(seconds)))


def live_rate(samples: DataFrame, ts: str, seconds: int = 2) -> DataFrame:
    """Per step: totals so far, the rate of the step and the rate since the start."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    steps = samples.groupBy(F.window(ts, f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("_sent"), F.count_if(failed).alias("_err")
    )
    steps = steps.select(F.col("w.start").alias("step_start"), F.col("w.end").alias("step_end"), "_sent", "_err")
    totals = with_running_sums(steps, [], "step_end", "step_end", {"sent": F.col("_sent"), "err": F.col("_err")}, slice_seconds=SERIES_SLICE)
    first = steps.agg(F.min(micros("step_start"))).scalar()
    totals = totals.withColumn("elapsed", (micros("step_end") - first) / F.lit(1_000_000.0)).withColumn("ok", F.col("sent") - F.col("err"))
    return totals.select(
        "step_end",
        "sent",
        "ok",
        "err",
        ((F.col("_sent") - F.col("_err")) / F.lit(float(seconds))).alias("current_rate"),
        (F.col("ok") / F.col("elapsed")).alias("overall_rate"),
    )


def consumer_lag(messages: DataFrame, commits: DataFrame, threshold: int = S.LAG_ALERT_THRESHOLD) -> DataFrame:
    """Per topic and partition: end of the log less the committed position (the next offset to read)."""
    ends = messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end_offset"))
    joined = ends.join(commits.select("topic", "partition", "committed"), ["topic", "partition"], "left")
    lag = F.greatest(F.lit(0), F.col("end_offset") - F.coalesce("committed", F.lit(0)))
    return joined.withColumn("lag", lag.cast("bigint")).withColumn("over_threshold", F.col("lag") > threshold)


def message_counts(messages: DataFrame, by: tuple[str, ...] = ("topic", "status")) -> DataFrame:
    return counts(messages, *by, name="messages")


def flush_stats(batches: DataFrame) -> DataFrame:
    """``metric, status, le, value`` from batch audit rows ``(batch_id, n, ms, status)``.

    Flush counts by status, events written and still unwritten, and latency and size histograms of the
    batches that were written.
    """
    good = batches.where(F.col("status") == "success")
    none = F.lit(None).cast("double")
    by_status = counts(batches, "status").select(
        F.lit("flush_total").alias("metric"), "status", none.alias("le"), F.col("n").cast("double").alias("value")
    )
    events = batches.groupBy("status").agg(F.sum("n").alias("n")).select(
        F.when(F.col("status") == "success", "events_total").otherwise("buffer_depth").alias("metric"),
        "status",
        none.alias("le"),
        F.col("n").cast("double").alias("value"),
    )

    def long(hist: DataFrame, metric: str) -> DataFrame:
        return hist.select(
            F.lit(metric).alias("metric"), F.lit("success").alias("status"), "le", F.col("cumulative").cast("double").alias("value")
        )

    latency = histogram(good.withColumn("s", F.col("ms") / 1000.0), "s", S.BUCKETS["flush_latency"])
    sizes = histogram(good.withColumn("s", F.col("n").cast("double")), "s", S.BUCKETS["flush_batch_size"])
    parts = [by_status, events, long(latency, "flush_latency"), long(sizes, "flush_batch_size")]
    return reduce(lambda a, b: a.unionByName(b), parts)


def worker_batch_size(polls: DataFrame) -> DataFrame:
    """Histogram of how many messages a poll delivered, from audit rows ``(batch_id, n, ms, status)``. A poll that failed is
    tried again, so only those that were handled count."""
    sizes = polls.where(F.col("status") == "success").withColumn("size", F.col("n").cast("double"))
    return histogram(sizes, "size", S.BUCKETS["worker_batch_size"])
