"""Streaming jobs over requests, messages, history and outbox.

Sources are streams of any connector with the right columns: the message source where it is on the
classpath, files otherwise (``maxOffsetsPerTrigger`` / ``maxFilesPerTrigger`` bound a batch). The
checkpoint takes the place of commits and acknowledgements: a batch counts as consumed when its sinks
are written, and a batch that is run again overwrites what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtide import schemas as S
from jobtide.operators import ingest, lookups, metrics, transitions
from jobtide.operators.history import latest
from jobtide.operators.skew import settled, settling
from jobtide.sources import messages as M
from jobtide.sources import tables
from jobtide.sources.buckets import BucketStore
from jobtide.streaming.audit import audited
from jobtide.streaming.outbox import OUTBOX_RANGE_ROWS, OutboxLog
from jobtide.streaming.sinks import drop_batch, path_exists, start, write_batch

#: How long a result waits for its task.
RESULT_HOLD_SECONDS = 3600


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_history(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """History rows appended to the monthly layout by the exactly-once file sink."""
    rows = tables.with_month(tables.log_columns(events))
    writer = rows.writeStream.format("parquet").partitionBy("event_month").option("path", path)
    return start(writer.outputMode("append"), checkpoint, trigger)


def stream_history_messages(
    messages: DataFrame, path: str, quarantine: str, checkpoint: str, trigger: dict | None = None, audit: str | None = None
) -> StreamingQuery:
    """Messages to history rows; what does not decode goes to the quarantine. Both from one read. ``audit``: a folder for a
    row per flush."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = M.read_history_messages(batch).persist()
        good, bad = M.split_history_messages(decoded)
        write_batch(tables.with_month(good), path, batch_id, ("event_month",))
        write_batch(bad, quarantine, batch_id)
        decoded.unpersist()

    return start(messages.writeStream.foreachBatch(audited(handle, audit)), checkpoint, trigger)


@dataclass(frozen=True)
class RequestTables:
    """Folders of the ingest job. ``keys`` is the store of the taken idempotency keys: a micro-batch asks the
    filters of its keys' buckets and reads only buckets that may hold one."""

    tasks: str
    history: str
    outbox: str
    outcomes: str
    keys: str

    def key_store(self) -> BucketStore:
        # The first owner of a key keeps it; a key is never stored twice.
        return BucketStore(self.keys, "idempotency_key", ("id",), with_filter=True)

    @classmethod
    def under(cls, root: str) -> RequestTables:
        return cls(*(f"{root}/{name}" for name in ("tasks", "history", "outbox", "outcomes", "keys")))


def ingest_batch(
    batch: DataFrame,
    batch_id: int,
    target: RequestTables,
    known_types: Iterable[str],
    as_of: str,
    order: list[str],
) -> None:
    """One batch of requests into tasks, history and outbox. Keys taken by earlier batches only are
    looked up, so running a batch again finds what it found the first time."""
    with settling():
        batch.persist()
        store = target.key_store()
        keys = batch.select("id", "idempotency_key").where("idempotency_key <> ''")
        taken = store.lookup(keys, batch_id - 1, keys.select("idempotency_key", "id").schema)
        made = ingest.create_tasks(batch, as_of, taken, known_types, order)
        tasks = made.tasks.persist()
        # Everything derives from the task rows and has ids that follow from them.
        at = F.col("created_at")
        write_batch(tables.encoded(tasks), target.tasks, batch_id)
        write_batch(ingest.history_rows(tasks, S.QUEUED, at), target.history, batch_id)
        write_batch(tables.outbox_rows(tasks, at), target.outbox, batch_id)
        write_batch(made.outcomes, target.outcomes, batch_id)
        store.append(tasks.where("idempotency_key IS NOT NULL").select("idempotency_key", "id"), batch_id)
        tasks.unpersist()
        batch.unpersist()


def stream_requests(
    requests: DataFrame,
    target: RequestTables,
    checkpoint: str,
    clock: Callable[[], str],
    known_types: Iterable[str] = S.BUILTIN_TYPES,
    order: list[str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Requests (with a unique ``id``) to stored tasks; keys stay unique for ever."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, target, known_types, clock(), order or ["id"])

    return start(requests.writeStream.foreachBatch(handle), checkpoint, trigger)


def unique_requests(requests: DataFrame, ts: str, watermark: str | None = None) -> DataFrame:
    """First request of every key, in the state store of the engine.

    Without a watermark a key stays taken for ever and state grows by one entry per key; with one, a key
    is free again after the delay. Requests without a key are told apart by their id, so they neither
    drop each other nor meet in one partition.
    """
    key = F.coalesce(
        F.concat(F.lit("key "), F.nullif(F.col("idempotency_key"), F.lit(""))), F.concat(F.lit("id "), F.col("id").cast("string"))
    )
    marked = requests.withColumn("_unique", key)
    if watermark is None:
        return marked.dropDuplicates(["_unique"]).drop("_unique")
    return marked.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["_unique"]).drop("_unique")


def stream_outbox(
    outbox: DataFrame,
    topic_path: str,
    published: str,
    quarantine: str,
    checkpoint: str,
    clock: Callable[[], str],
    trigger: dict | None = None,
    broker: dict[str, str] | None = None,
    send: Callable[[DataFrame, int, int], None] | None = None,
    range_rows: int = OUTBOX_RANGE_ROWS,
    keep_seconds: int = S.OUTBOX_KEEP_SECONDS,
) -> StreamingQuery:
    """Outbox rows to the task topic, oldest first, range by range (``OutboxLog``). A row counts as published once its range is
    sent; a row that does not decode goes to the quarantine and counts as published too, or it would block for ever.
    ``send(messages, batch, range)`` takes the place of the files or the broker; it may get several ranges at once (``range`` is the first).
    Each row is decoded once, ahead of the sendings, as decoding takes far longer than they do."""

    def opened(rows: DataFrame) -> DataFrame:
        # Rows of a plan have been decoded already, but for those of a plan that an earlier version made.
        return rows if "raw_payload" in rows.columns else M.read_outbox_payloads(rows.repartition("id"))

    log = OutboxLog(published, range_rows, keep_seconds, opened)

    def deliver(rows: DataFrame, batch_id: int, number: int) -> None:
        good = rows.where("good").orderBy("created_at", "id").select(
            F.col("task_id").alias("id"), *[c for c in S.OUTBOX_PAYLOAD.names if c != "task_id"], F.lit(0).alias("retry_count"), "created_at"
        )
        messages = M.to_task_messages(good)
        if send:
            send(messages, batch_id, number)
        elif broker:
            M.write_messages(messages, topic_path, broker)
        else:
            messages.write.mode("overwrite").parquet(f"{topic_path}/batch_id={batch_id}/range={number}")
        bad = rows.where("NOT good").select("id", F.col("raw_task_id").alias("task_id"), F.col("raw_payload").alias("payload"), "created_at")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch_id={batch_id}/range={number}")

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.publish(batch, batch_id, deliver, clock())

    return start(outbox.writeStream.foreachBatch(handle), checkpoint, trigger)


def stream_messages(
    messages: DataFrame,
    tasks: Callable[[], DataFrame],
    to_run: str,
    skipped: str,
    quarantine: str,
    checkpoint: str,
    trigger: dict | None = None,
    audit: str | None = None,
) -> StreamingQuery:
    """Deliveries to work: broken ones to the quarantine, those of finished tasks skipped, the rest to
    run. ``tasks`` is read anew for every batch, which is how a redelivery finds its task finished. ``audit``: a
    folder for a row per poll."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = M.read_task_messages(batch).persist()
        good, bad = M.split_task_messages(decoded)
        run, skip = lookups.skip_terminal(good, tasks())
        write_batch(tables.encoded(run), to_run, batch_id)
        write_batch(skip.select("task_id", "meta"), skipped, batch_id)
        write_batch(bad, quarantine, batch_id)
        decoded.unpersist()

    return start(messages.writeStream.foreachBatch(audited(handle, audit)), checkpoint, trigger)


def stream_current_state(history: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Latest status per task: each batch adds the latest row of its tasks to a bucketed store, which folds them
    when they are read and compacts its buckets one by one. No state is kept beside the store."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        with settling():
            _state_store(path).append(settled(latest(batch)), batch_id)

    return start(history.writeStream.foreachBatch(handle), checkpoint, trigger)


def _state_store(path: str) -> BucketStore:
    return BucketStore(path, "task_id", ("occurred_at", "seq", "id"))


def current_from_changes(spark: SparkSession, path: str) -> DataFrame:
    """State after the last complete batch of ``stream_current_state``."""
    versions = spark.read.parquet(f"{path}_parts").agg(F.max("batch_id")).first()[0]
    written = spark.read.parquet(path).drop("batch_id", "bucket")
    return _state_store(path).read(spark, int(versions), written.schema).drop("seq")


def rates(events: DataFrame, ts: str, by: list[str], delay: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Events per second in tumbling windows, each window once, when it closes."""
    window = F.window(ts, f"{seconds} seconds")
    counted = events.withWatermark(ts, delay).groupBy(window, *by).agg(F.count("*").alias("events"))
    return counted.select(
        F.col("window.start").alias("window_start"), *by, "events", (F.col("events") / F.lit(float(seconds))).alias("per_second")
    )


def sliding_quantiles(
    events: DataFrame,
    ts: str,
    value: str,
    by: list[str],
    q: float = 0.95,
    bounds: tuple[float, ...] = S.BUCKETS["task_duration"],
    width: str = "5 minutes",
    slide: str = "1 minute",
    delay: str = "1 minute",
) -> DataFrame:
    """Histogram quantile per sliding window. Only the bucket counts are state."""
    window = F.window(ts, width, slide)
    wide = metrics.bucket_counts(events.withWatermark(ts, delay), value, bounds, [window.alias("window"), *by])
    quantile = metrics.quantile_of(F.col("cumulative"), F.col("total"), bounds, q).alias("quantile")
    return wide.select(F.col("window.start").alias("window_start"), *by, "total", quantile)


def live_totals(samples: DataFrame, ts: str, seconds: int = 2, delay: str = "10 seconds") -> DataFrame:
    """Per step sent / ok / err and the rate of the step; running totals are a batch step over its output."""
    failed = F.coalesce(F.col("error") != "", F.lit(False))
    steps = samples.withWatermark(ts, delay).groupBy(F.window(ts, f"{seconds} seconds").alias("w"))
    counted = steps.agg(F.count("*").alias("sent"), F.count_if(failed).alias("err"))
    ok = F.col("sent") - F.col("err")
    return counted.select(
        F.col("w.end").alias("step_end"), "sent", ok.alias("ok"), "err", (ok / F.lit(float(seconds))).alias("current_rate")
    )


def end_to_end(created: DataFrame, finished: DataFrame, within: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """``created (task_id, created_at)`` matched with ``finished (task_id, status, finished_at)``; tasks
    that do not finish in time come out with NULLs once the watermark has passed the bound."""
    left = created.withWatermark("created_at", delay).alias("c")
    right = finished.withWatermark("finished_at", delay).alias("f")
    on = F.expr(
        f"c.task_id = f.task_id AND f.finished_at >= c.created_at AND f.finished_at <= c.created_at + INTERVAL {within}"
    )
    joined = left.join(right, on, "left_outer")
    micros = F.unix_micros("f.finished_at") - F.unix_micros("c.created_at")
    return joined.select("c.task_id", "c.created_at", "f.status", "f.finished_at", (micros / F.lit(1_000_000.0)).alias("e2e_seconds"))


def stream_to_files(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Any append-only result to the exactly-once file sink."""
    return start(rows.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint, trigger)


def stream_dlq(
    results: DataFrame,
    tasks: Callable[[], DataFrame],
    retries: str,
    dead: str,
    checkpoint: str,
    clock: Callable[[], str],
    trigger: dict | None = None,
    parked: str | None = None,
    unmatched: str | None = None,
    hold_seconds: int = RESULT_HOLD_SECONDS,
) -> StreamingQuery:
    """Run results split: dead letters to a sink that is kept for ever, retries to their own.

    A result may be ahead of its task. Such results are parked and tried again with every batch; those that have waited
    ``hold_seconds`` go to ``unmatched`` instead, so no result is lost without a trace. The parked ones of a batch are a folder
    of their own, which a batch that is run again reads and replaces; folders two batches back are removed.
    """
    parked, unmatched = parked or f"{dead}_parked", unmatched or f"{dead}_unmatched"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, as_of = batch.sparkSession, clock()
        now = F.lit(as_of).cast("timestamp")
        waiting = batch.select("id", "ok", "error", "known_type", now.alias("parked_at"))
        if path_exists(spark, f"{parked}/batch_id={batch_id - 1}"):
            before = spark.read.schema(waiting.schema).parquet(f"{parked}/batch_id={batch_id - 1}")
            waiting = waiting.unionByName(before)
        waiting.persist()
        known = tasks()
        routed = transitions.failure_route(known, waiting.drop("parked_at")).persist()
        again = transitions.requeue_rows(routed.where("outcome = 'retry'"), as_of)
        write_batch(again.select("id", *transitions.CHANGED), retries, batch_id)
        lost = transitions.dlq_rows(routed.where("outcome = 'dead_lettered'"), F.col("error"), as_of)
        write_batch(tables.encoded(lost), dead, batch_id)
        ahead = waiting.join(known.select("id"), "id", "left_anti").persist()
        expired = F.col("parked_at") + F.make_dt_interval(secs=F.lit(hold_seconds).cast("decimal(18,6)")) <= now
        write_batch(ahead.where(expired), unmatched, batch_id)
        write_batch(ahead.where(~expired), parked, batch_id)
        drop_batch(spark, parked, batch_id - 2)
        for rows in (ahead, routed, waiting):
            rows.unpersist()

    return start(results.writeStream.foreachBatch(handle), checkpoint, trigger)


def drop_expired(rows: DataFrame, ts: str, seconds: int, as_of: str | Column) -> DataFrame:
    """Stream filter for a topic with a retention: only rows younger than it pass."""
    at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return rows.where(F.col(ts) >= at.cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)")))
