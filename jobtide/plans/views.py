"""Lifecycle tables seen in the generic test tables.

Every view is a projection ``{column: SQL expression}`` over one test table. The text is valid in
Spark and in ANSI SQL engines, so queries and their SQL counterparts read the same inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.jsontext import decode_payload
from jobtide.sources.tables import decoded

TASKS_AS_OF = "1998-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-15 00:00:00"

_PADDED = "concat('00000000-0000-4000-8000-', lpad(CAST({} AS STRING), 12, '0'))"
_TASK_UUID = _PADDED.format("user_id")
_TYPE = "CASE WHEN o_orderkey % 3 = 0 THEN 'send_email' WHEN o_orderkey % 3 = 1 THEN 'run_query' ELSE 'noop' END"
_PAYLOAD = "concat('{\"cust\":\"', CAST(o_custkey AS STRING), '\"}')"
_PRIORITY = "CAST(6 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS INT)"

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "task_requests": (
        "orders",
        {
            "id": "o_orderkey",
            "name": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('task-', CAST(o_orderkey AS STRING)) END",
            "type": "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'bogus' ELSE " + _TYPE + " END",
            "payload": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE " + _PAYLOAD + " END",
            "priority": _PRIORITY,
            "max_retries": "CAST(o_orderkey % 4 AS INT)",
            "timeout_seconds": "CAST(30 * (o_orderkey % 3) AS INT)",
            "idempotency_key": "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('k', CAST(o_custkey AS STRING), '-',"
            " CAST(o_orderkey % 3 AS STRING)) END",
            "requested_at": "o_orderdate",
            "batch_id": "CASE WHEN o_custkey < 150 THEN 0 ELSE o_custkey END",
        },
    ),
    "tasks": (
        "orders",
        {
            "id": "o_orderkey",
            "name": "concat('task-', CAST(o_orderkey AS STRING))",
            "type": _TYPE,
            "payload": _PAYLOAD,
            "status": "CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'"
            " WHEN o_custkey % 5 = 0 THEN 'dead_lettered' WHEN o_custkey % 7 = 0 THEN 'failed' ELSE 'succeeded' END",
            "priority": _PRIORITY,
            "retry_count": "CAST(o_custkey % 5 AS INT)",
            "max_retries": "3",
            "timeout_seconds": "CAST(30 * (1 + o_orderkey % 4) AS INT)",
            "idempotency_key": "CAST(NULL AS STRING)",
            "created_at": "o_orderdate",
            "updated_at": "o_orderdate + INTERVAL '1' MINUTE * CAST(o_custkey % 30 AS INT)",
            "run_after": "o_orderdate + INTERVAL '1' HOUR * CAST(o_custkey % 7 AS INT)",
        },
    ),
    "stored_keys": (
        "customer",
        {
            "id": "-1 - c_custkey",
            "idempotency_key": "CASE WHEN c_custkey % 3 = 0 THEN concat('k', CAST(c_custkey AS STRING), '-0') ELSE NULL END",
        },
    ),
    "task_history": (
        "events",
        {
            "id": "event_id",
            "task_id": "user_id",
            "status": "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running'"
            " WHEN 'purchase' THEN 'succeeded' ELSE 'dead_lettered' END",
            "occurred_at": "ts",
        },
    ),
    "samples": (
        "events",
        {
            "index": "event_id",
            "kind": "event_type",
            "seen_at": "ts",
            "error": "CASE WHEN event_type = 'error' THEN 'refused' ELSE '' END",
            "latency_seconds": "value",
        },
    ),
    "outbox": (
        "events",
        {
            "id": "event_id",
            "task_id": "user_id",
            "payload": "props",
            "created_at": "ts",
            "published_at": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL '1' SECOND *"
            " CAST(1 + event_id % 100 AS INT) END",
        },
    ),
    "access_log": (
        "events",
        {
            "seen_at": "ts",
            "method": "CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN 'POST' ELSE 'GET' END",
            "path": "CASE event_type WHEN 'signup' THEN '/tasks' WHEN 'error' THEN '/tasks/batch'"
            " WHEN 'click' THEN concat('/tasks/', " + _TASK_UUID + ")"
            " WHEN 'view' THEN concat('/tasks/', " + _TASK_UUID + ", '/history')"
            " ELSE concat('/dlq/tasks/', " + _TASK_UUID + ", '/retry') END",
            "status": "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 500 WHEN event_id % 10 = 1 THEN 404 ELSE 200 END",
        },
    ),
    "messages": (
        "events",
        {
            "event_id": "event_id",
            "topic": "CASE WHEN event_type = 'error' THEN 'tasks-dlq' ELSE 'tasks' END",
            "partition": "CAST(event_id % 8 AS INT)",
            "offset": "CAST(floor(event_id / 8) AS BIGINT)",
            "timestamp": "ts",
            "status": "CASE WHEN event_id % 50 = 0 THEN 'error' ELSE 'success' END",
            "task_value": "CASE WHEN event_id % 10 = 3 THEN '{not json'"
            " WHEN event_id % 10 = 5 THEN concat('{\"task_id\":\"not-a-uuid\",\"name\":\"x\",\"type\":\"', event_type, '\"}')"
            " WHEN event_id % 10 = 7 THEN concat('{\"task_id\":\"', " + _TASK_UUID + ", '\",\"name\":\"x\",\"priority\":\"7\"}')"
            " ELSE concat('{\"task_id\":\"', " + _TASK_UUID + ", '\",\"name\":\"job-', CAST(event_id AS STRING),"
            " '\",\"type\":\"', event_type, '\",\"payload\":', props_text(props), ',\"priority\":', CAST(event_id % 9 AS STRING),"
            " ',\"max_retries\":3,\"timeout_seconds\":30,\"retry_count\":', CAST(event_id % 4 AS STRING), '}') END",
            "history_value": "CASE WHEN event_id % 10 = 3 THEN '[1,'"
            " WHEN event_id % 10 = 5 THEN '{\"task_id\":\"nope\",\"status\":\"queued\",\"at\":\"2024-01-01T00:00:00Z\"}'"
            " WHEN event_id % 10 = 7 THEN concat('{\"task_id\":\"', " + _TASK_UUID + ", '\",\"status\":\"queued\",\"at\":\"soon\"}')"
            " ELSE concat('{\"task_id\":\"', " + _TASK_UUID + ", '\",\"status\":\"running\",\"at\":\"',"
            " replace(CAST(ts AS STRING), ' ', 'T'), 'Z\"}') END",
        },
    ),
}
# The test tables hold ``{"k": 69}``; a message payload has text values.
_PROPS = "replace(replace(props, ': ', ':\"'), '}', '\"}')"
VIEWS["messages"][1]["task_value"] = VIEWS["messages"][1]["task_value"].replace("props_text(props)", _PROPS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, sf_dir, source).selectExpr(*[f"{expr} AS {column}" for column, expr in columns.items()])


def view_sql(name: str) -> str:
    source, columns = VIEWS[name]
    inner = ", ".join(f'{expr} AS "{column}"' for column, expr in columns.items())
    return f"SELECT {inner} FROM {source}"


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form has JSON text; operators take the decoded map."""
    return decoded(view(spark, sf_dir, "tasks"), strict=False)


def task_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed behind a one-element ``inline``, as the request reader does: once per row, not per use."""
    rows = view(spark, sf_dir, "task_requests").withColumnRenamed("payload", "_text")
    opened = rows.select("*", F.inline(F.array(F.struct(decode_payload("_text").alias("payload")))))
    return opened.drop("_text")


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead-letter table: one row per dead-lettered task, with an id of its own."""
    rows = tasks(spark, sf_dir).where("status = 'dead_lettered'")
    return rows.select(
        (F.col("id") + F.lit(DLQ_OFFSET)).alias("id"),
        F.col("id").alias("original_task_id"),
        "name",
        "type",
        "payload",
        "priority",
        "retry_count",
        "max_retries",
        "timeout_seconds",
        F.concat(F.lit("error "), F.col("retry_count").cast("string")).alias("error_message"),
        F.col("created_at").alias("original_created_at"),
        F.col("updated_at").alias("dead_lettered_at"),
    )


DLQ_OFFSET = 10_000_000_000

DEAD_LETTERS_SQL = f"""
SELECT id + {DLQ_OFFSET} AS id, id AS original_task_id, name, type, payload, priority, retry_count, max_retries,
 timeout_seconds, concat('error ', CAST(retry_count AS STRING)) AS error_message, created_at AS original_created_at,
 updated_at AS dead_lettered_at
FROM tasks WHERE status = 'dead_lettered'
"""


def with_views(*names: str) -> str:
    """``WITH`` clause for a SQL counterpart; ``dead_letters`` brings ``tasks`` along."""
    wanted = list(dict.fromkeys(names))
    if "dead_letters" in wanted and "tasks" not in wanted:
        wanted.insert(0, "tasks")
    parts = [f"{n} AS ({DEAD_LETTERS_SQL if n == 'dead_letters' else view_sql(n)})" for n in wanted]
    return "WITH " + ",\n".join(parts) + "\n"
