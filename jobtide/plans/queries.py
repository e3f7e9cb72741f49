"""Registered queries over the test tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions import headers as H
from jobtide.functions.jsontext import encode_payload
from jobtide.functions.scalars import canonical_uuid, check_task_id
from jobtide.operators import dispatch, handlers, history, ingest, lookups, metrics, sets, transitions
from jobtide.plans import report
from jobtide.plans import tick as ticks
from jobtide.plans import views as V
from jobtide.sources import messages as M
from jobtide.sources import metric_text, requests, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

T_AS_OF, E_AS_OF = V.TASKS_AS_OF, V.EVENTS_AS_OF
NTZ = "timestamp_ntz"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


SHARES, SHARE_SIZE, SPLIT_SIZE = 200, "2m", "4m"


def in_shares(fn: Query) -> Query:
    """For queries that sort whole task rows behind several shuffles: they run in a session with the caller's settings where a
    shuffle starts from at least ``SHARES`` partitions, adaptive execution puts together no more than ``SHARE_SIZE``, and a scan task
    reads ``SPLIT_SIZE``. By default there are hardly more tasks than cores, so a task's sorts and counts grow with the table."""

    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        own = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                own.conf.set(name, value)
        own.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(max(SHARES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", SHARE_SIZE)
        own.conf.set("spark.sql.files.maxPartitionBytes", SPLIT_SIZE)
        return fn(own, sf)

    return run


def flat(df: DataFrame) -> DataFrame:
    """Maps as JSON text, which every engine can compare."""
    return df.withColumn("payload", encode_payload("payload"))


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Run results of the running tasks: every third failed, types other than the known ones unknown."""
    running = V.tasks(spark, sf).where(F.col("status") == S.RUNNING)
    return running.select(
        "id",
        (F.col("id") % 3 != 0).alias("ok"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("boom "), F.col("id").cast("string"))).alias("error"),
        (F.col("type") != "noop").alias("known_type"),
    )


def task_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.view(spark, sf, "messages")
    return rows.withColumn("value", F.col("task_value").cast("binary")).drop("task_value", "history_value")


def history_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.view(spark, sf, "messages")
    return rows.withColumn("value", F.col("history_value").cast("binary")).drop("task_value", "history_value", "status")


# --- tables and messages -------------------------------------------------------------------------


@query
def tasks_scan(spark, sf):
    decoded = V.tasks(spark, sf)
    return decoded.select(*[c for c in S.TASK_COLUMNS if c != "payload"], F.col("payload")["cust"].alias("payload_cust"))


@query
def history_month_scan(spark, sf):
    """The range scan of the monthly layout, with the month condition that prunes directories."""
    monthly = tables.with_month(V.view(spark, sf, "task_history"))
    return tables.history_between(monthly, "2024-01-10 00:00:00", "2024-01-20 12:00:00")


@query
def month_layout_counts(spark, sf):
    monthly = tables.with_month(V.view(spark, sf, "task_history"))
    return metrics.counts(monthly, "event_month", "status")


@query
def outbox_scan(spark, sf):
    rows = V.view(spark, sf, "outbox")
    return rows.select("id", "task_id", F.from_json("payload", "k int")["k"].alias("k"), F.col("published_at").isNull().alias("pending"))


@query
def message_parse_outcomes(spark, sf):
    decoded = M.read_task_messages(task_messages(spark, sf))
    reason = F.coalesce("reject_reason", F.lit("ok")).alias("outcome")
    return metrics.counts(decoded, "topic", reason)


@query
def message_parse_fields(spark, sf):
    good, _ = M.parse_task_messages(task_messages(spark, sf))
    return good.select(
        "task_id",
        "name",
        "type",
        "priority",
        "retry_count",
        F.col("payload")["k"].alias("payload_k"),
        F.col("meta")["partition"].alias("meta_partition"),
        F.col("meta")["offset"].alias("meta_offset"),
        F.col("meta")["topic"].alias("meta_topic"),
    )


@query
def message_quarantine(spark, sf):
    _, bad = M.parse_task_messages(task_messages(spark, sf))
    return bad.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"), "reject_reason")


@query
def history_parse_outcomes(spark, sf):
    decoded = M.read_history_messages(history_messages(spark, sf))
    reason = F.coalesce("reject_reason", F.lit("ok")).alias("outcome")
    late = F.when(F.col("occurred_at").cast(NTZ) == F.col("timestamp"), 1).otherwise(0)
    return decoded.groupBy(reason, "status").agg(F.count("*").alias("n"), F.sum(late).alias("at_record_time"))


@query
def message_encode(spark, sf):
    sent = M.to_task_messages(V.tasks(spark, sf))
    return sent.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        H.get_header("headers", "task_id").alias("h_task_id"),
        H.get_header("headers", "retry_count").alias("h_retry_count"),
        "topic",
    )


@query
def dlq_message_encode(spark, sf):
    dead = V.tasks(spark, sf).where(F.col("status") == S.DEAD_LETTERED)
    sent = M.to_dlq_messages(dead, F.concat(F.lit("error "), F.col("retry_count").cast("string")))
    return sent.select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        H.get_header("headers", "task_id").alias("h_task_id"),
        H.get_header("headers", "error").alias("h_error"),
        "topic",
    )


@query
def history_encode(spark, sf):
    sent = M.to_history_messages(V.view(spark, sf, "task_history"))
    return sent.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic")


@query
def outbox_build(spark, sf):
    """Outbox rows of the queued tasks."""
    queued = V.tasks(spark, sf).where(F.col("status") == S.QUEUED)
    return tables.outbox_rows(queued, T_AS_OF)


@query
def header_ops(spark, sf):
    log = V.view(spark, sf, "samples")
    made = H.build_headers(kind=F.col("kind"), index=F.col("index"))
    changed = H.set_header(H.set_header(made, "kind", F.upper("kind")), "trace", F.concat(F.lit("t"), F.col("index").cast("string")))
    with_headers = log.select("index", changed.alias("headers"))
    return with_headers.select(
        "index",
        H.get_header("headers", "kind").alias("kind"),
        H.get_header("headers", "trace").alias("trace"),
        H.get_header("headers", "absent").alias("absent"),
        F.concat_ws(",", H.header_keys("headers")).alias("keys"),
    )


@query
def request_parse(spark, sf):
    """Request documents, some of them broken, through the strict decoder."""
    rows = V.view(spark, sf, "messages").select("event_id", F.col("task_value").alias("value"))
    return requests.parse_requests(rows).select("event_id", "json_ok", "name", "type", "priority", F.col("payload")["k"].alias("payload_k"))


@query
def request_key_case(spark, sf):
    """Request documents with key names in any case, doubled keys and doubled payload keys: the last one counts."""
    rows = V.view(spark, sf, "messages").select("event_id", F.col("status"))
    n = F.col("event_id").cast("string")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"NAME":"a'), n, F.lit('","Type":"noop","Priority":3,"PAYLOAD":{"K":"up","k":"low"}}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"name":"first","type":"x","Name":"b'), n, F.lit('","TYPE":"run_query","priority":1,"PRIORITY":2}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"name":"c'), n, F.lit('","type":"noop","payload":{"k":"one","k":"two"},"max_retries":9}')))
        .otherwise(F.concat(F.lit('{"name":"d'), n, F.lit('","Type":5,"priority":"7"}')))
    )
    parsed = requests.parse_requests(rows.select("event_id", text.alias("value")))
    return parsed.select("event_id", "json_ok", "name", "type", "priority", "max_retries", F.col("payload")["k"].alias("payload_k"))


@query
def metric_text_parse(spark, sf):
    """Exposition lines made from the event log, one comment and one unwanted series among them."""
    log = V.view(spark, sf, "samples")
    line = (
        F.when(F.col("index") % 7 == 0, F.concat(F.lit("# HELP tasks_created_total "), F.col("kind")))
        .when(F.col("index") % 7 == 1, F.concat(F.lit("go_goroutines "), F.col("index").cast("string")))
        .otherwise(F.concat(F.lit('tasks_created_total{type="'), F.col("kind"), F.lit('"} '), F.col("index").cast("string")))
    )
    parsed = metric_text.parse_metric_text(log.select(line.alias("value")))
    return parsed.groupBy("name", F.col("labels")["type"].alias("type")).agg(
        F.count("*").alias("n"), F.sum("sample").alias("sample_sum")
    )


@query
def task_id_check(spark, sf):
    """Path ids in several spellings, parsed or refused."""
    plain = F.regexp_extract("path", "([0-9a-f]{8}-[0-9a-f-]{27})", 1)
    spelled = (
        F.when(F.col("status") == 404, F.concat(F.lit("{"), F.upper(plain), F.lit("}")))
        .when(F.col("method") == "GET", F.replace(plain, F.lit("-"), F.lit("")))
        .otherwise(F.concat(F.lit("urn:uuid:"), plain))
    )
    ids = V.view(spark, sf, "access_log").select(spelled.alias("raw"))
    return ids.groupBy(canonical_uuid("raw").alias("task_id"), check_task_id("raw").alias("code")).agg(F.count("*").alias("n"))


# --- requests ------------------------------------------------------------------------------------


@query
def request_defaults(spark, sf):
    ready = ingest.apply_request_defaults(V.task_requests(spark, sf), T_AS_OF, NTZ)
    return ready.select("id", "max_retries", "timeout_seconds", "idempotency_key", "status", "retry_count", "created_at", "run_after")


@query
def request_validation(spark, sf):
    return ingest.validate_requests(V.task_requests(spark, sf)).select("id", "code", "message")


@query
def known_type_filter(spark, sf):
    """Membership in a registry that is itself a table."""
    registry = V.view(spark, sf, "tasks").select("type").distinct()
    return ingest.known_types(V.task_requests(spark, sf), registry, known=False).select("id", "type")


def _batches(spark, sf):
    """Requests in batches with a position; the position is the id, which keeps their order."""
    return V.task_requests(spark, sf).withColumn("idx", F.col("id"))


@query
def batch_validation(spark, sf):
    return ingest.validate_batches(_batches(spark, sf))


@query
def batch_create(spark, sf):
    _, made = ingest.create_task_batches(_batches(spark, sf), T_AS_OF, ts_type=NTZ)
    return made.tasks.select("id", "type", "max_retries", "timeout_seconds", "idempotency_key", "status")


def _resolved(spark, sf):
    ready = ingest.apply_request_defaults(V.task_requests(spark, sf), T_AS_OF, NTZ)
    return ingest.resolve_idempotency(ready, V.view(spark, sf, "stored_keys"), ["requested_at"])


@query
def idempotency_resolve(spark, sf):
    return _resolved(spark, sf).select("id", "idempotency_key", "task_id", "outcome")


def _created(spark, sf):
    return ingest.create_tasks(
        V.task_requests(spark, sf), T_AS_OF, V.view(spark, sf, "stored_keys"), order=["requested_at"], ts_type=NTZ
    )


@query
def create_tasks(spark, sf):
    return flat(_created(spark, sf).tasks).select(*S.TASK_COLUMNS)


@query
def create_outcomes(spark, sf):
    return _created(spark, sf).outcomes


@query
def create_deltas(spark, sf):
    """The history and outbox rows that go with the created tasks."""
    made = _created(spark, sf)
    log = made.history.select(F.lit("history").alias("part"), "task_id", F.col("status").alias("body"), F.col("occurred_at").alias("at"))
    box = made.outbox.select(F.lit("outbox").alias("part"), "task_id", F.col("payload").alias("body"), F.col("created_at").alias("at"))
    return sets.append_deltas(log, box)


# --- lookups -------------------------------------------------------------------------------------


def _asked(spark, sf):
    """Ids to look up: line items name orders, and some ids beyond the table."""
    lines = V.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    return lines.distinct()


@query
def task_lookup(spark, sf):
    return lookups.lookup_tasks(V.view(spark, sf, "tasks"), _asked(spark, sf)).select("id", "found", "status", "priority")


@query
def dlq_lookup(spark, sf):
    ids = _asked(spark, sf).select((F.col("id") + V.DLQ_OFFSET).alias("id"))
    return lookups.lookup_dlq(V.dead_letters(spark, sf), ids).select("id", "found", "original_task_id", "error_message")


def _deliveries(spark, sf):
    return V.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 2).alias("task_id"), "l_linenumber")


@query
def skip_terminal(spark, sf):
    flagged = lookups.with_terminal_flag(_deliveries(spark, sf), V.view(spark, sf, "tasks"))
    return flagged.groupBy("task_id", "skip").agg(F.count("*").alias("n"))


@query
def skipped_count(spark, sf):
    return lookups.skipped_count(lookups.with_terminal_flag(_deliveries(spark, sf), V.view(spark, sf, "tasks")))


@query
def history_for_tasks(spark, sf):
    log, tasks = V.view(spark, sf, "task_history"), V.view(spark, sf, "tasks")
    ids = V.table(spark, sf, "customer").select((F.col("c_custkey") * 11).alias("id"))
    return lookups.history_for(log, tasks, ids).select("task_id", "task_exists", "id", "status", "occurred_at")


@query
def task_timeline(spark, sf):
    return history.task_timeline(V.view(spark, sf, "task_history"))


@query
def orphan_history(spark, sf):
    queued = V.view(spark, sf, "tasks").where(F.col("status") != S.QUEUED)
    return lookups.orphan_history(V.view(spark, sf, "task_history"), queued).select("id", "task_id", "status")


@query
def orphan_dlq(spark, sf):
    dlq = V.dead_letters(spark, sf)
    return lookups.orphan_dlq(dlq, V.view(spark, sf, "tasks").where("retry_count > 0")).select("id", "original_task_id")


# --- state changes -------------------------------------------------------------------------------


@query
def claim_topk(spark, sf):
    return transitions.claim_topk(V.view(spark, sf, "tasks"), 100, T_AS_OF).select("id", "priority", "created_at")


@query
def claim_assign(spark, sf):
    moved = transitions.claim(V.tasks(spark, sf), 100, T_AS_OF, workers=8).dispatch_delta
    return moved.select("id", "claim_rank", "worker", "status", "updated_at")


@query
def set_status(spark, sf):
    tasks = V.view(spark, sf, "tasks")
    lines = V.table(spark, sf, "lineitem")
    updates = lines.select((F.col("l_orderkey") * 2).alias("id"), F.lower("l_linestatus").alias("status"), "l_linenumber", "l_partkey")
    place = F.struct("l_linenumber", "l_partkey", "status")
    delta = transitions.set_status(tasks, updates.withColumn("place", place), T_AS_OF, order="place").tasks_delta
    after = transitions.apply_transitions(tasks, delta)
    return metrics.counts(after, "status", "updated_at")


def _changes(spark, sf):
    """Three ordered status changes for some tasks, each of them delivered twice."""
    ids = V.view(spark, sf, "tasks").where(F.col("id") % 5 == 0).select("id")
    steps = F.array(
        F.struct(F.lit(S.RUNNING).alias("status"), F.lit(1).alias("place")),
        F.struct(F.lit(S.QUEUED).alias("status"), F.lit(2).alias("place")),
        F.struct(F.when(F.col("id") % 10 == 0, S.SUCCEEDED).otherwise(S.QUEUED).alias("status"), F.lit(3).alias("place")),
    )
    return ids.select("id", F.explode(F.concat(steps, steps)).alias("c")).select("id", "c.status", "c.place")


@query
def set_status_repeated(spark, sf):
    """Log rows and table rows of changes that came more than once."""
    moved = transitions.set_status(V.view(spark, sf, "tasks"), _changes(spark, sf), T_AS_OF, order="place")
    log = moved.history_delta.select(F.lit("log").alias("part"), "id", "task_id", "status", "seq")
    table = moved.tasks_delta.select(F.lit("table").alias("part"), F.lit(None).cast("string").alias("id"), F.col("id").alias("task_id"), "status", "seq")
    return sets.append_deltas(log, table)


@query
def apply_transitions_repeated(spark, sf):
    """A delta whose rows came twice and out of date, with a map among its columns."""
    tasks = V.tasks(spark, sf)
    rows = tasks.where(F.col("id") % 3 == 0).select("id", F.upper("status").alias("status"), F.create_map(F.lit("cust"), F.lit("new")).alias("payload"), F.lit(2).cast("bigint").alias("seq"))
    stale = rows.withColumns({"status": F.lit("zombie"), "payload": F.create_map(F.lit("cust"), F.lit("old")), "seq": F.lit(1).cast("bigint")})
    after = transitions.apply_transitions(tasks, rows.unionByName(stale).unionByName(rows))
    return after.select("id", "status", F.col("payload")["cust"].alias("payload_cust"), "seq")


@query
def fold_at_one_instant(spark, sf):
    """Four state changes at one instant: the fold of their log must end where the table does, for every task."""
    tasks, log = V.tasks(spark, sf), []

    def step(moved):
        nonlocal tasks
        log.append(moved.history_delta)
        tasks = transitions.apply_transitions(tasks, moved.tasks_delta)

    failures = tasks.where(F.col("id") % 3 == 0).select("id", F.lit("boom").alias("error_message"))
    lost = transitions.dead_letter(tasks, failures, T_AS_OF)
    step(lost)
    asked = lost.dlq_delta.where(F.col("original_task_id") % 2 == 0).select("id")
    step(transitions.dlq_retry(lost.dlq_delta, tasks, asked, T_AS_OF))
    step(transitions.set_status(tasks, _changes(spark, sf), T_AS_OF, order="place"))
    folded = history.current_state(sets.append_deltas(*log)).select(F.col("task_id").alias("id"), F.col("status").alias("logged"))
    both = tasks.join(folded, "id", "left")
    return both.groupBy("status").agg(F.count("*").alias("n"), F.count("logged").alias("moved"), F.count_if(F.col("logged") != F.col("status")).alias("apart"))


@query
def requeue_backoff(spark, sf):
    tasks = V.tasks(spark, sf)
    running = tasks.where(F.col("status") == S.RUNNING).select("id")
    return transitions.requeue(tasks, running, T_AS_OF).tasks_delta.drop("seq")


@query
def dlq_snapshot(spark, sf):
    tasks = V.tasks(spark, sf)
    failures = results(spark, sf).where(~F.col("ok")).select("id", F.col("error").alias("error_message"))
    rows, _ = transitions.dlq_snapshot(failures, tasks, T_AS_OF)
    return flat(rows)


@query
def reap_plan(spark, sf):
    return transitions.reap_plan(V.view(spark, sf, "tasks"), T_AS_OF).select("id", "retry_count", "outcome")


@query
def reap_counts(spark, sf):
    return metrics.reap_counts(transitions.reap_plan(V.view(spark, sf, "tasks"), T_AS_OF))


@query
def reap_deltas(spark, sf):
    """Dead letters and history rows of the reap."""
    moved = transitions.reap(V.tasks(spark, sf), T_AS_OF)
    dead = moved.dlq_delta.select(F.lit("dlq").alias("part"), F.col("original_task_id").alias("task_id"), F.col("error_message").alias("body"))
    log = moved.history_delta.select(F.lit("history").alias("part"), "task_id", F.col("status").alias("body"))
    return sets.append_deltas(dead, log)


@query
def apply_transitions(spark, sf):
    tasks = V.tasks(spark, sf)
    after = transitions.apply_transitions(tasks, transitions.reap(tasks, T_AS_OF).tasks_delta.drop("outcome"), unique=True)
    return after.select("id", "status", "retry_count", "updated_at", "run_after")


def _retried(spark, sf):
    dlq = V.dead_letters(spark, sf)
    ids = V.table(spark, sf, "customer").select((F.col("c_custkey") * 3 + V.DLQ_OFFSET).alias("id"))
    return transitions.dlq_retry(dlq, V.tasks(spark, sf), ids, T_AS_OF)


@query
def dlq_retry(spark, sf):
    return _retried(spark, sf).tasks_delta.drop("seq")


@query
def dlq_retry_remaining(spark, sf):
    done = _retried(spark, sf)
    left = done.dlq_after.select(F.lit("left").alias("part"), "id")
    return sets.append_deltas(left, done.not_found.select(F.lit("not_found").alias("part"), "id"))


@query
def failure_route(spark, sf):
    return transitions.route_outcomes(V.tasks(spark, sf), results(spark, sf), T_AS_OF).tasks_delta.drop("seq")


@query
@in_shares
def route_deltas(spark, sf):
    """Everything else that comes with routed results: log rows, dead letters, work to send again, and ids without a task."""
    more = results(spark, sf).withColumn("id", F.when(F.col("id") % 7 == 0, F.col("id") + 5_000_000_000).otherwise(F.col("id")))
    moved = transitions.route_outcomes(V.tasks(spark, sf), more.unionByName(more), T_AS_OF)
    none = F.lit(None).cast("string")
    log = moved.history_delta.select(F.lit("log").alias("part"), F.col("task_id").alias("id"), F.col("status").alias("body"))
    dead = moved.dlq_delta.select(F.lit("dead").alias("part"), F.col("original_task_id").alias("id"), F.col("error_message").alias("body"))
    again = moved.dispatch_delta.select(F.lit("again").alias("part"), F.col("task_id").alias("id"), none.alias("body"))
    missing = moved.not_found.select(F.lit("missing").alias("part"), "id", none.alias("body"))
    return sets.append_deltas(log, dead, again, missing)


@query
def lifecycle_tick(spark, sf):
    done = ticks.lifecycle_tick(V.tasks(spark, sf), T_AS_OF, k=100, workers=8)
    return ticks.tick_summary(done)


@query
def tick_status_counts(spark, sf):
    """Statuses of the whole task table after one tick."""
    done = ticks.lifecycle_tick(V.tasks(spark, sf), T_AS_OF, k=100, workers=8)
    return metrics.counts(done.tasks_after, "status")


def mirror(payload: dict[str, str], deadline: handlers.Deadline) -> None:
    """Fails for customers whose number ends in 7."""
    if payload["cust"].endswith("7"):
        raise ValueError(f"refused {payload['cust']}")


@query
def execute_handlers(spark, sf):
    running = V.tasks(spark, sf).where(F.col("status") == S.RUNNING)
    ran = handlers.execute(running, {"send_email": mirror, "run_query": handlers.noop})
    return ran.select("id", "type", "ok", "error", "known_type")


# --- listings ------------------------------------------------------------------------------------


@query
def outbox_poll(spark, sf):
    return dispatch.outbox_poll(V.view(spark, sf, "outbox"))


@query
def outbox_depth(spark, sf):
    return metrics.outbox_depth(V.view(spark, sf, "outbox"))


@query
def outbox_prune(spark, sf):
    return dispatch.outbox_prune(V.view(spark, sf, "outbox"), E_AS_OF).select("id", "published_at")


@query
def outbox_mark_published(spark, sf):
    box = V.view(spark, sf, "outbox")
    return dispatch.mark_published(box, dispatch.outbox_poll(box), "2024-02-01 00:00:00").select("id", "published_at")


@query
def dlq_list(spark, sf):
    return flat(dispatch.dlq_list(V.dead_letters(spark, sf)))


@query
def monitor_sample(spark, sf):
    return dispatch.monitor_sample(V.view(spark, sf, "samples").where("error = ''")).select("index", "latency_seconds")


@query
def retention(spark, sf):
    return dispatch.retain(V.view(spark, sf, "task_history"), "occurred_at", S.RETENTION_SECONDS["tasks"], E_AS_OF)


@query
def snapshot_diff(spark, sf):
    """The task table against itself after a reap: rows lost and gained."""
    columns = ["id", "status", "retry_count", "updated_at", "run_after"]
    tasks = V.tasks(spark, sf)
    after = transitions.apply_transitions(tasks, transitions.reap(tasks, T_AS_OF).tasks_delta.drop("outcome"), unique=True)
    return sets.snapshot_diff(tasks.select(*columns), after.select(*columns))


# --- history -------------------------------------------------------------------------------------


@query
def current_state(spark, sf):
    return history.current_state(V.view(spark, sf, "task_history"))


def _tied(spark, sf):
    """The log with its times cut to hours: most rows share their instant with others and go by their ordinal."""
    log = V.view(spark, sf, "task_history")
    return log.withColumns({"occurred_at": F.date_trunc("hour", "occurred_at").cast(NTZ), "seq": (F.col("id") * 7 % 5).cast("bigint")})


@query
def current_state_ties(spark, sf):
    return history.current_state(_tied(spark, sf))


@query
def audit_ties(spark, sf):
    return history.lifecycle_audit(_tied(spark, sf)).select("id", "task_id", "prev_status", "status")


@query
def attempts_ties(spark, sf):
    return history.attempts(_tied(spark, sf)).select("id", "task_id", "status", "cycle", "attempt")


@query
def transition_steps(spark, sf):
    steps = history.transitions(V.view(spark, sf, "task_history"))
    return steps.select("id", "task_id", "status", "prev_status", F.round("gap_seconds", 3).alias("gap_seconds"))


@query
def next_steps(spark, sf):
    steps = history.next_transitions(V.view(spark, sf, "task_history"))
    return steps.select("id", "status", "next_status", F.round("gap_seconds", 3).alias("gap_seconds"))


@query
def transition_matrix(spark, sf):
    return history.transition_matrix(V.view(spark, sf, "task_history"))


@query
def lifecycle_audit(spark, sf):
    return history.lifecycle_audit(V.view(spark, sf, "task_history")).select("id", "task_id", "prev_status", "status")


@query
def attempts(spark, sf):
    return history.attempts(V.view(spark, sf, "task_history")).select("id", "task_id", "status", "cycle", "attempt")


@query
def queue_wait(spark, sf):
    waits = history.queue_wait(V.view(spark, sf, "task_history"))
    return waits.select("task_id", "started_at", F.round("wait_seconds", 3).alias("wait_seconds"))


@query
def execution_duration(spark, sf):
    runs = history.execution_duration(V.view(spark, sf, "task_history"))
    tasks = V.view(spark, sf, "tasks").select(F.col("id").alias("task_id"), "type")
    typed = runs.join(tasks, "task_id", "left")
    return typed.groupBy("type", "outcome").agg(
        F.count("*").alias("n"),
        F.round(F.min("duration_seconds"), 3).alias("shortest"),
        F.round(F.max("duration_seconds"), 3).alias("longest"),
    )


@query
def e2e_latency(spark, sf):
    rows = history.e2e_latency(V.view(spark, sf, "task_history"), V.view(spark, sf, "tasks"))
    return rows.select("task_id", "cycle", "type", "status", "created_at", "finished_at", F.round("e2e_seconds", 3).alias("e2e_seconds"))


# --- measures ------------------------------------------------------------------------------------


@query
def terminal_counts(spark, sf):
    return metrics.terminal_counts(V.view(spark, sf, "tasks"))


@query
def status_breakdown(spark, sf):
    return metrics.status_breakdown(V.view(spark, sf, "tasks"))


@query
def completion_summary(spark, sf):
    return metrics.completion_summary(V.view(spark, sf, "tasks"))


@query
def dlq_depth(spark, sf):
    return metrics.dlq_depth(V.dead_letters(spark, sf))


@query
def dlq_depth_series(spark, sf):
    return metrics.dlq_depth_series(V.view(spark, sf, "task_history"))


@query
def in_progress(spark, sf):
    return metrics.in_progress(V.view(spark, sf, "tasks"))


@query
def in_progress_series(spark, sf):
    return metrics.in_progress_series(V.view(spark, sf, "task_history"))


@query
def created_by_type(spark, sf):
    return metrics.created_by_type(_resolved(spark, sf), batch=F.col("batch_id") == 0)


@query
def processed_by_type_status(spark, sf):
    return metrics.processed_by_type_status(transitions.failure_route(V.view(spark, sf, "tasks"), results(spark, sf)))


@query
def requests_by_route(spark, sf):
    return metrics.requests_by_route(V.view(spark, sf, "access_log"))


@query
def severity_counts(spark, sf):
    return metrics.severity_counts(V.view(spark, sf, "access_log"))


@query
def error_rate(spark, sf):
    rates = metrics.error_rate(V.view(spark, sf, "samples").withColumn("day", F.to_date("seen_at")), ["day"])
    return rates.withColumn("error_rate", F.round("error_rate", 6))


@query
def throughput(spark, sf):
    rate = metrics.throughput(V.view(spark, sf, "samples"), "seen_at", F.col("error") == "")
    return rate.select("n", F.round("span_seconds", 3).alias("span_seconds"), F.round("per_second", 9).alias("per_second"))


@query
def latency_percentiles(spark, sf):
    return metrics.latency_percentiles(V.view(spark, sf, "samples"), "latency_seconds", ["kind"])


@query
def latency_percentiles_overall(spark, sf):
    return metrics.latency_percentiles(V.view(spark, sf, "samples"), "latency_seconds")


@query
def duration_histogram(spark, sf):
    hist = metrics.histogram(V.view(spark, sf, "samples"), "latency_seconds", S.BUCKETS["task_duration"], ["kind"])
    return hist.withColumn("value_sum", F.round("value_sum", 2))


@query
def histogram_p95(spark, sf):
    hist = metrics.histogram(V.view(spark, sf, "samples"), "latency_seconds", S.BUCKETS["task_duration"], ["kind"])
    return metrics.histogram_quantile(hist, 0.95, ["kind"]).withColumn("quantile", F.round("quantile", 9))


@query
def histogram_p25(spark, sf):
    samples = V.view(spark, sf, "samples")
    return metrics.value_quantile(samples, "latency_seconds", S.BUCKETS["task_duration"], 0.25, ["kind"]).withColumn("quantile", F.round("quantile", 9))


@query
def event_rate(spark, sf):
    rates = metrics.event_rate(V.view(spark, sf, "samples"), "seen_at", ["kind"])
    return rates.withColumn("per_second", F.round("per_second", 9))


@query
def live_rate(spark, sf):
    """Two-hour steps stand for the two-second ones: the log spans a month."""
    steps = metrics.live_rate(V.view(spark, sf, "samples"), "seen_at", 7200)
    return steps.withColumns({"current_rate": F.round("current_rate", 9), "overall_rate": F.round("overall_rate", 9)})


@query
def live_rate_default(spark, sf):
    """The two-second steps that samples fall into."""
    steps = metrics.live_rate(V.view(spark, sf, "samples"), "seen_at")
    return steps.withColumns({"current_rate": F.round("current_rate", 9), "overall_rate": F.round("overall_rate", 9)})


@query
def consumer_lag(spark, sf):
    log = V.view(spark, sf, "messages")
    read = log.where(F.col("timestamp") < F.lit(E_AS_OF).cast(NTZ))
    commits = read.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("committed"))
    return metrics.consumer_lag(log, commits.where("topic <> 'tasks-dlq'"))


@query
def message_counts(spark, sf):
    return metrics.message_counts(V.view(spark, sf, "messages"))


@query
def load_report(spark, sf):
    """Creation and completion over the event log: every event a call, its kind what became of it."""
    samples = V.view(spark, sf, "samples").withColumn("created_at", F.col("seen_at"))
    finished = V.view(spark, sf, "task_history").join(
        V.view(spark, sf, "samples").select(F.col("index").alias("id"), F.col("latency_seconds").alias("e2e_seconds")), "id"
    )
    made = report.load_report(samples, finished.withColumn("finished_at", F.col("occurred_at")))
    return made.withColumn("value", F.round("value", 6))
