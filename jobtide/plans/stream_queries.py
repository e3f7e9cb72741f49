"""Streaming jobs run to the end of the test tables; the result is what their sinks hold."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce, wraps

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtide import schemas as S
from jobtide.functions.jsontext import decode_payload
from jobtide.operators import metrics, transitions
from jobtide.operators.skew import settled
from jobtide.plans import tick as ticks
from jobtide.plans import views as V
from jobtide.plans.queries import NTZ, Query
from jobtide.plans.queries import query as register
from jobtide.plans.tick import Store
from jobtide.sources import tables
from jobtide.sources.buckets import BucketStore
from jobtide.streaming import jobs, timers
from jobtide.streaming.audit import read_audit
from jobtide.streaming.sinks import drop_folder, shared_folder


BATCH_PARTITIONS, BATCH_PARTITION_SIZE = 200, "8m"


def stream_view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A view over its test table read as a stream, with zoned times so that watermarks work."""
    source, columns = V.VIEWS[name]
    schema = V.table(spark, sf, source).schema
    # A pattern, as a stream takes a plain path for a folder; it fits a single file and a folder of files.
    rows = spark.readStream.schema(schema).parquet(f"{sf}/{source}.parque[t]")
    rows = rows.selectExpr(*[f"{expr} AS {column}" for column, expr in columns.items()])
    times = {f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == NTZ}
    return rows.withColumns(times)


def query(fn: Query) -> Query:
    """Registers a query that runs in a session of its own, with as many state partitions as the cluster has cores:
    the caller's settings stay as they are. Batch steps start from more partitions, which adaptive execution puts together by
    their size, so a task's share of large tables stays small."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = spark.newSession()
        cores = spark.sparkContext.defaultParallelism
        own.conf.set("spark.sql.shuffle.partitions", str(cores))
        own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(cores, BATCH_PARTITIONS)))
        own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", BATCH_PARTITION_SIZE)
        return fn(own, sf)

    return register(run)


class Run:
    """A folder for one run. What its streams have read and their checkpoints go when it ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, shared_folder(spark)

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *problem) -> None:
        for name in ("in", "checkpoint"):
            drop_folder(self.spark, self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def finish(self, job: StreamingQuery) -> None:
        job.awaitTermination()

    def append(self, rows: DataFrame) -> DataFrame:
        self.finish(jobs.stream_to_files(rows, self.path("out"), self.path("checkpoint")))
        return self.read("out")

    def read(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(self.path(name)).drop("batch_id")
        times = {f.name: F.col(f.name).cast(NTZ) for f in rows.schema if f.dataType.typeName() == "timestamp"}
        return rows.withColumns(times) if times else rows


@query
def stream_history_append(spark, sf):
    with Run(spark) as run:
        job = jobs.stream_history(stream_view(spark, sf, "task_history"), run.path("out"), run.path("checkpoint"))
        run.finish(job)
        return run.read("out")


@query
def stream_history_messages(spark, sf):
    """Decoded and quarantined messages together, told apart by ``part``."""
    with Run(spark) as run:
        rows = stream_view(spark, sf, "messages").drop("status")
        rows = rows.withColumn("value", F.col("history_value").cast("binary"))
        run.finish(jobs.stream_history_messages(rows, run.path("good"), run.path("bad"), run.path("checkpoint")))
        good = run.read("good").select(F.lit("good").alias("part"), F.col("task_id").alias("key"), F.col("status").alias("note"))
        bad = run.read("bad").select(F.lit("bad").alias("part"), F.col("offset").cast("string").alias("key"), F.col("reject_reason").alias("note"))
        return good.unionByName(bad).groupBy("part", "key", "note").agg(F.count("*").alias("n"))


def _flushed(spark: SparkSession, sf: str, run: Run, job) -> DataFrame:
    """Audit rows of a job over the messages in four parts. The first attempt at the third part cannot write and fails."""
    rows = V.view(spark, sf, "messages").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    for part, (low, high) in enumerate([(0, 7), (7, 40), (40, 400), (400, None)]):
        chosen = rows.where(F.col("event_id") >= low) if high is None else rows.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        chosen.write.mode("append").parquet(run.path("in"))
        stream = spark.readStream.schema(rows.schema).parquet(run.path("in"))
        if part == 2:
            try:
                run.finish(job(stream, "nowhere://quarantine"))
            except StreamingQueryException:
                pass
        run.finish(job(stream, run.path("quarantine")))
    return read_audit(spark, run.path("audit"))


@query
def flush_stats(spark, sf):
    """Measures of the flushes that a run made: all but the latencies, which no two runs share; their number is given."""
    with Run(spark) as run:

        def job(stream, quarantine):
            encoded = stream.withColumn("value", F.col("history_value").cast("binary")).drop("status")
            return jobs.stream_history_messages(encoded, run.path("good"), quarantine, run.path("checkpoint"), audit=run.path("audit"))

        stats = metrics.flush_stats(_flushed(spark, sf, run, job))
        return stats.where((F.col("metric") != "flush_latency") | (F.col("le") == float("inf")))


@query
def worker_batch_size(spark, sf):
    """Sizes of the polls that a run made."""
    with Run(spark) as run:
        known = V.view(spark, sf, "tasks").select(F.format_string("00000000-0000-4000-8000-%012d", "id").alias("id"), "status")

        def job(stream, quarantine):
            encoded = stream.withColumn("value", F.col("task_value").cast("binary")).drop("task_value", "history_value", "status")
            paths = [run.path("to_run"), run.path("skipped"), quarantine, run.path("checkpoint")]
            return jobs.stream_messages(encoded, lambda: known, *paths, audit=run.path("audit"))

        return metrics.worker_batch_size(_flushed(spark, sf, run, job)).drop("value_sum")


@query
def stream_requests(spark, sf):
    with Run(spark) as run:
        target = jobs.RequestTables.under(run.path("db"))
        rows = stream_view(spark, sf, "task_requests").withColumn("payload", decode_payload("payload"))
        run.finish(
            jobs.stream_requests(rows, target, run.path("checkpoint"), lambda: V.TASKS_AS_OF, order=["requested_at"])
        )
        made = run.read("db/tasks").select("id", "type", "max_retries", "idempotency_key")
        return made.join(run.read("db/outbox").select(F.col("task_id").alias("id")), "id", "left_semi")


@query
def stream_unique_keys(spark, sf):
    """Which keys came through the unbounded de-duplication (which of their requests is open)."""
    with Run(spark) as run:
        rows = stream_view(spark, sf, "task_requests").select("id", "idempotency_key", "requested_at")
        kept = run.append(jobs.unique_requests(rows, "requested_at"))
        return kept.groupBy("idempotency_key").agg(F.count("*").alias("n"))


@query
def stream_outbox(spark, sf):
    with Run(spark) as run:
        box = stream_view(spark, sf, "messages").select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("task_id"),
            F.col("task_value").alias("payload"),
            F.col("timestamp").alias("created_at"),
            F.when(F.col("event_id") % 3 == 1, F.col("timestamp")).alias("published_at"),
        )
        paths = [run.path(p) for p in ("topic", "published", "quarantine", "checkpoint")]
        run.finish(jobs.stream_outbox(box, *paths, lambda: V.EVENTS_AS_OF))
        sent = run.read("topic").select(F.lit("sent").alias("part"), F.get_json_object(F.col("value").cast("string"), "$.name").alias("name"))
        bad = run.read("quarantine").select(F.lit("bad").alias("part"), F.col("id").cast("string").alias("name"))
        marked = run.read("published").select(F.lit("marked").alias("part"), F.col("id").cast("string").alias("name"))
        return sent.unionByName(bad).unionByName(marked)


@query
def outbox_log_order(spark, sf):
    """In which batch each row was published when the second range of the first batch could not be sent: nothing behind it goes
    before it, and the next batch takes up there."""
    with Run(spark) as run:
        box = V.view(spark, sf, "messages").select(
            F.col("event_id").alias("id"),
            F.col("event_id").alias("task_id"),
            F.col("task_value").alias("payload"),
            F.col("timestamp").cast("timestamp").alias("created_at"),
            F.when(F.col("event_id") % 3 == 1, F.col("timestamp").cast("timestamp")).alias("published_at"),
        )
        paths = [run.path(p) for p in ("topic", "published", "quarantine", "checkpoint")]

        def broken(messages, batch, number):
            if number:
                raise ConnectionError("the topic is away")

        for rows, send in ((box.where("id % 9 > 0"), broken), (box.where("id % 9 = 0"), None)):
            rows.write.mode("append").parquet(run.path("in"))
            stream = spark.readStream.schema(rows.schema).parquet(run.path("in"))
            run.finish(jobs.stream_outbox(stream, *paths, lambda: V.EVENTS_AS_OF, send=send, range_rows=500))
        return spark.read.parquet(run.path("published")).select("id", F.col("batch_id").cast("bigint").alias("batch_id"))


@query
def stream_messages(spark, sf):
    with Run(spark) as run:
        rows = stream_view(spark, sf, "messages").withColumn("value", F.col("task_value").cast("binary"))
        rows = rows.drop("task_value", "history_value", "status")
        known = V.view(spark, sf, "tasks")
        ids = known.select(F.format_string("00000000-0000-4000-8000-%012d", "id").alias("id"), "status")
        paths = [run.path(p) for p in ("to_run", "skipped", "quarantine", "checkpoint")]
        run.finish(jobs.stream_messages(rows, lambda: ids, *paths))
        parts = [run.read(p).select(F.lit(p).alias("part")) for p in ("to_run", "skipped", "quarantine")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part").agg(F.count("*").alias("n"))


@query
def stream_current_state(spark, sf):
    with Run(spark) as run:
        history = stream_view(spark, sf, "task_history")
        run.finish(jobs.stream_current_state(history, run.path("out"), run.path("checkpoint")))
        state = jobs.current_from_changes(spark, run.path("out"))
        return state.withColumn("occurred_at", F.col("occurred_at").cast(NTZ))


@query
def stream_rates(spark, sf):
    with Run(spark) as run:
        rates = run.append(jobs.rates(stream_view(spark, sf, "samples"), "seen_at", ["kind"]))
        return rates.withColumn("per_second", F.round("per_second", 9))


@query
def stream_sliding_p95(spark, sf):
    with Run(spark) as run:
        samples = stream_view(spark, sf, "samples")
        slid = run.append(jobs.sliding_quantiles(samples, "seen_at", "latency_seconds", ["kind"], width="5 hours", slide="1 hour"))
        return slid.withColumn("quantile", F.round("quantile", 9))


@query
def stream_sliding_p95_default(spark, sf):
    """Five minutes wide, every minute."""
    with Run(spark) as run:
        slid = run.append(jobs.sliding_quantiles(stream_view(spark, sf, "samples"), "seen_at", "latency_seconds", ["kind"]))
        return slid.withColumn("quantile", F.round("quantile", 9))


@query
def stream_live_totals_default(spark, sf):
    """Steps of two seconds."""
    with Run(spark) as run:
        live = run.append(jobs.live_totals(stream_view(spark, sf, "samples"), "seen_at"))
        return live.withColumn("current_rate", F.round("current_rate", 9))


@query
def stream_live_totals(spark, sf):
    with Run(spark) as run:
        live = run.append(jobs.live_totals(stream_view(spark, sf, "samples"), "seen_at", 7200))
        return live.withColumn("current_rate", F.round("current_rate", 9))


@query
def stream_end_to_end(spark, sf):
    """Two streams matched by id: every event is created; all but errors finish ``value`` seconds later. Those that do not
    finish within the hour come out as soon as the watermark has closed it."""
    with Run(spark) as run:
        created = stream_view(spark, sf, "samples").select(F.col("index").alias("task_id"), F.col("seen_at").alias("created_at"))
        took = F.make_dt_interval(secs=F.col("latency_seconds").cast("decimal(18,6)"))
        finished = stream_view(spark, sf, "samples").where("error = ''").select(
            F.col("index").alias("task_id"), F.col("kind").alias("status"), (F.col("seen_at") + took).alias("finished_at")
        )
        out = run.append(jobs.end_to_end(created, finished, within="1 hour"))
        return out.withColumn("e2e_seconds", F.round("e2e_seconds", 6))


@query
def stream_reaper(spark, sf):
    with Run(spark) as run:
        history = stream_view(spark, sf, "task_history").withColumns(
            {
                "retry_count": (F.col("task_id") % 5).cast("int"),
                "max_retries": F.lit(3),
                "timeout_seconds": (F.lit(30) * (1 + F.col("task_id") % 4)).cast("int"),
            }
        )
        return run.append(timers.stream_reaper(history))


def _in_arrival_order(run: Run, rows: DataFrame, parts: int = 3) -> Iterator[DataFrame]:
    """A stream of ``rows`` that grows by a part at a time, in the order of ``arrived_at``; each part is a batch or more."""
    days = F.dayofmonth("arrived_at")
    for part in range(parts):
        last = F.lit(True) if part == parts - 1 else days < 31 // parts * (part + 1)
        rows.where((days >= 31 // parts * part) & last).write.mode("append").parquet(run.path("in"))
        yield run.spark.readStream.schema(rows.schema).parquet(run.path("in"))


@query
def stream_reaper_late(spark, sf):
    """Rows that arrive up to ten minutes late, in three parts: a run counts as stuck only if no result of it turns up within the
    hold-back, however late that is."""
    with Run(spark) as run:
        late = F.make_dt_interval(secs=(F.col("id") * 37 % 600).cast("decimal(18,6)"))
        history = V.view(spark, sf, "task_history").withColumns(
            {
                "occurred_at": F.col("occurred_at").cast("timestamp"),
                "retry_count": (F.col("task_id") % 5).cast("int"),
                "max_retries": F.lit(3),
                "timeout_seconds": (F.lit(30) * (1 + F.col("task_id") % 4)).cast("int"),
            }
        )
        for rows in _in_arrival_order(run, history.withColumn("arrived_at", F.col("occurred_at") + late)):
            out = run.append(timers.stream_reaper(rows, "1 second", 600))
        return out


@query
def stream_due_retries_late(spark, sf):
    """Failures that arrive up to ten minutes late, long after most retries were due, and each of them twice."""
    with Run(spark) as run:
        late = F.make_dt_interval(secs=(F.col("task_id") * 37 % 600).cast("decimal(18,6)"))
        failures = V.view(spark, sf, "samples").where("error <> ''").select(
            F.col("index").alias("task_id"),
            F.col("seen_at").cast("timestamp").alias("failed_at"),
            (F.col("index") % 5).cast("int").alias("retry_count"),
            F.lit(4).alias("max_retries"),
        )
        twice = failures.unionByName(failures).withColumn("arrived_at", F.col("failed_at") + late)
        for rows in _in_arrival_order(run, twice):
            out = run.append(timers.stream_due_retries(rows, "1 second", 600))
        return out


@query
def stream_due_retries(spark, sf):
    with Run(spark) as run:
        failures = stream_view(spark, sf, "samples").where("error <> ''").select(
            F.col("index").alias("task_id"),
            F.col("seen_at").alias("failed_at"),
            (F.col("index") % 5).cast("int").alias("retry_count"),
            F.lit(4).alias("max_retries"),
        )
        return run.append(timers.stream_due_retries(failures))


@query
def stream_dlq(spark, sf):
    with Run(spark) as run:
        results = stream_view(spark, sf, "tasks").where(F.col("status") == S.RUNNING).select(
            "id",
            (F.col("id") % 3 != 0).alias("ok"),
            F.concat(F.lit("boom "), F.col("id").cast("string")).alias("error"),
            (F.col("type") != "noop").alias("known_type"),
        )
        tasks = V.tasks(spark, sf)
        paths = [run.path(p) for p in ("retries", "dead", "checkpoint")]
        run.finish(jobs.stream_dlq(results, lambda: tasks, *paths, lambda: V.TASKS_AS_OF))
        again = run.read("retries").select(F.lit("retry").alias("part"), "id", "run_after", F.lit(None).cast("string").alias("error"))
        dead = run.read("dead").select(
            F.lit("dead").alias("part"), F.col("original_task_id").alias("id"), F.lit(None).cast(NTZ).alias("run_after"), F.col("error_message").alias("error")
        )
        return again.unionByName(dead)


@query
def stream_dlq_ahead(spark, sf):
    """Results of tasks half of which are not there yet, then all of them: every result ends in a sink. Results of no task are
    parked, and leave for the sink of unmatched ones when their time is over."""
    with Run(spark) as run:
        tasks = V.tasks(spark, sf)
        running = tasks.where(F.col("status") == S.RUNNING)
        fails = lambda rows, wrong: rows.select(
            (F.col("id") + (F.lit(1) if wrong else F.lit(0)) * 5_000_000_000).alias("id"),
            F.lit(False).alias("ok"),
            F.concat(F.lit("boom "), F.col("id").cast("string")).alias("error"),
            F.lit(True).alias("known_type"),
        )
        paths = [run.path(p) for p in ("retries", "dead", "checkpoint")]
        # First all results against half of the tasks, then a few more results against all of them, then one when time is over.
        last = running.agg(F.max("id").alias("id"))
        turns = [
            (fails(running, False).unionByName(fails(running.where("id % 5 = 0"), True)), tasks.where("id % 2 = 0"), "1998-06-01 00:00:00"),
            (fails(last, True), tasks, "1998-06-01 00:30:00"),
            (fails(last, False), tasks.where("id < 0"), "1998-06-01 01:10:00"),
        ]
        for rows, known, clock in turns:
            rows.write.mode("append").parquet(run.path("in"))
            stream = spark.readStream.schema(rows.schema).parquet(run.path("in"))
            run.finish(jobs.stream_dlq(stream, lambda known=known: known, *paths, lambda clock=clock: clock, parked=run.path("parked"), unmatched=run.path("unmatched")))
        parts = {"retry": ("retries", "id"), "dead": ("dead", "original_task_id"), "unmatched": ("unmatched", "id")}
        return reduce(DataFrame.unionByName, [run.read(folder).select(F.lit(part).alias("part"), F.col(key).alias("id")) for part, (folder, key) in parts.items()])


@query
def stream_retention(spark, sf):
    with Run(spark) as run:
        history = stream_view(spark, sf, "task_history")
        kept = jobs.drop_expired(history, "occurred_at", S.RETENTION_SECONDS["history"], V.EVENTS_AS_OF)
        return run.append(kept)


@query
def retention_drop(spark, sf):
    """What is left on disk of a log of four months when everything before a moment in the third one has been dropped."""
    with Run(spark) as run:
        log = V.view(spark, sf, "task_history")
        spread = F.make_dt_interval(days=((F.col("id") % 4).cast("int") - 2) * 30)
        log = log.withColumns({c: F.col(c).cast("string") for c in ("id", "task_id")} | {"occurred_at": (F.col("occurred_at") + spread).cast("timestamp")})
        tables.append_history(log, run.path("history"))
        tables.drop_history_before(spark, run.path("history"), "2024-01-10 12:00:00")
        return run.read("history").select("id", "task_id", "status", "occurred_at", F.col("event_month").cast("string").alias("event_month"))


@query
def key_store_rounds(spark, sf):
    """Idempotency keys taken in five batches; each batch asks the store which of its keys are taken."""
    with Run(spark) as run:
        store = BucketStore(run.path("keys"), "idempotency_key", ("id",), buckets=8, most_parts=2, with_filter=True)
        wanted = V.view(spark, sf, "task_requests").where("idempotency_key <> ''").select("idempotency_key", "id")
        for batch in range(5):
            mine = wanted.where(F.col("id") % 5 == batch).groupBy("idempotency_key").agg(F.min("id").alias("id"))
            taken = store.lookup(mine, batch - 1, wanted.schema)
            store.append(settled(mine.join(taken.select("idempotency_key"), "idempotency_key", "left_anti")), batch)
        return store.lookup(wanted, 4, wanted.schema)


@query
def task_store_rounds(spark, sf):
    """Four rounds of changes over the stored tasks, with buckets that are compacted on the way."""
    with Run(spark) as run:
        store = Store(run.path("db"), buckets=8, most_parts=2)
        tasks = V.tasks(spark, sf).withColumn("id", F.col("id").cast("string"))
        ticks.save_tasks(tasks.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "run_after")}), store, 0)
        for version in range(1, 5):
            now = store.tasks(spark, version - 1)
            changed = now.where(F.col("id").cast("bigint") % (version + 2) == 0)
            delta = changed.select("id", F.lit(f"round {version}").alias("status"), (F.col("seq") + 1).alias("seq"))
            ticks.save_changes(now, delta, store, version)
        return store.tasks(spark, 4).select("id", "status", "seq", F.col("payload")["cust"].alias("payload_cust"))


@query
def history_layout_roundtrip(spark, sf):
    """The log written by month, read back over a range and compared with what was written."""
    with Run(spark) as run:
        log = V.view(spark, sf, "task_history").withColumns(
            {c: F.col(c).cast("string") for c in ("id", "task_id")} | {"occurred_at": F.col("occurred_at").cast("timestamp")}
        )
        tables.append_history(log, run.path("history"))
        back = tables.read_history(spark, run.path("history"), "2024-01-05 00:00:00", "2024-01-25 00:00:00")
        return back.drop("seq").withColumn("occurred_at", F.col("occurred_at").cast(NTZ))


@query
def history_repartitioned(spark, sf):
    """A flat log copied into the monthly layout, read over a range, and the way back."""
    with Run(spark) as run:
        log = V.view(spark, sf, "task_history").withColumns(
            {c: F.col(c).cast("string") for c in ("id", "task_id")} | {"occurred_at": F.col("occurred_at").cast("timestamp")}
        )
        log.write.parquet(run.path("flat"))
        tables.repartition_history(spark, run.path("flat"), run.path("monthly"))
        tables.flatten_history(spark, run.path("monthly"), run.path("back"))
        ranged = tables.read_history(spark, run.path("monthly"), "2024-01-05 00:00:00", "2024-01-08 00:00:00")
        parts = [ranged.drop("seq").withColumn("part", F.lit("range")), spark.read.parquet(run.path("back")).withColumn("part", F.lit("back"))]
        return parts[0].unionByName(parts[1]).withColumn("occurred_at", F.col("occurred_at").cast(NTZ))


@query
def dlq_table_roundtrip(spark, sf):
    """The dead-letter table written, appended to and read through its schema."""
    with Run(spark) as run:
        dead = V.dead_letters(spark, sf).withColumns({c: F.col(c).cast("string") for c in ("id", "original_task_id")})
        dead = dead.withColumns({c: F.col(c).cast("timestamp") for c in ("original_created_at", "dead_lettered_at")})
        for odd in (0, 1):
            tables.write_dlq(dead.where(F.col("retry_count") % 2 == odd), run.path("dlq"))
        back = tables.read_dlq(spark, run.path("dlq"))
        return back.select("id", "original_task_id", "error_message", "retry_count", F.col("payload")["cust"].alias("payload_cust"), F.col("dead_lettered_at").cast(NTZ).alias("dead_lettered_at"))


@query
def outbox_table_roundtrip(spark, sf):
    """Outbox rows of the queued tasks written, read and their payload parsed."""
    with Run(spark) as run:
        queued = V.tasks(spark, sf).where(F.col("status") == S.QUEUED).withColumn("id", F.col("id").cast("string"))
        times = {c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "run_after")}
        tables.write_outbox(queued.withColumns(times), run.path("outbox"), V.TASKS_AS_OF)
        back = tables.read_outbox(spark, run.path("outbox"))
        return back.select("task_id", F.col("message.type").alias("type"), F.col("message.priority").alias("priority"), F.col("message.payload")["cust"].alias("payload_cust"), F.col("published_at").isNull().alias("pending"))


@query
def task_table_roundtrip(spark, sf):
    """The task table written, read through its schema and reaped."""
    with Run(spark) as run:
        tasks = V.tasks(spark, sf).withColumn("id", F.col("id").cast("string"))
        times = {c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "run_after")}
        tables.write_tasks(tasks.withColumns(times), run.path("tasks"))
        stored = tables.read_tasks(spark, run.path("tasks"))
        moved = transitions.reap(stored, V.TASKS_AS_OF)
        return moved.tasks_delta.select("id", "status", "retry_count", "outcome")
