"""Schemas, status values, error codes and histogram bounds shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

# Task statuses.
QUEUED = "queued"
RUNNING = "running"
SUCCEEDED = "succeeded"
FAILED = "failed"
DEAD_LETTERED = "dead_lettered"
STATUSES = (QUEUED, RUNNING, SUCCEEDED, FAILED, DEAD_LETTERED)
TERMINAL_STATUSES = (SUCCEEDED, FAILED, DEAD_LETTERED)

# Legal (previous, next) status pairs; "start" stands for "no earlier row".
START = "start"
LEGAL_TRANSITIONS = (
    (START, QUEUED),
    (QUEUED, RUNNING),
    (RUNNING, SUCCEEDED),
    (RUNNING, QUEUED),
    (RUNNING, DEAD_LETTERED),
    (RUNNING, FAILED),
    (DEAD_LETTERED, QUEUED),
)

# Task types with a built-in handler.
BUILTIN_TYPES = ("send_email", "run_query", "noop")

# Column defaults and limits.
DEFAULT_MAX_RETRIES = 3
DEFAULT_TIMEOUT_SECONDS = 30
BACKOFF_BASE_SECONDS = 5
BACKOFF_CAP_SECONDS = 300
MAX_BATCH_REQUESTS = 1000
OUTBOX_POLL_ROWS = 500
OUTBOX_KEEP_SECONDS = 3600
MONITOR_SAMPLE_ROWS = 10_000
LAG_ALERT_THRESHOLD = 1000
REAPED_MESSAGE = "reaped: task stuck in running state beyond timeout"

# How long each topic keeps its records, in seconds (None: for ever).
RETENTION_SECONDS = {"tasks": 604_800, "dlq": None, "history": 86_400}

# Validation codes and messages.
INVALID_JSON_BODY = "INVALID_JSON_BODY"
NAME_REQUIRED = "NAME_REQUIRED"
TYPE_REQUIRED = "TYPE_REQUIRED"
UNKNOWN_TASK_TYPE = "UNKNOWN_TASK_TYPE"
PAYLOAD_NULL = "PAYLOAD_NULL"
EMPTY_BATCH = "EMPTY_BATCH"
BATCH_TOO_LARGE = "BATCH_TOO_LARGE"
INVALID_TASK_ID = "INVALID_TASK_ID"
INVALID_DLQ_TASK_ID = "INVALID_DLQ_TASK_ID"
OK = "OK"
MESSAGES = {
    INVALID_JSON_BODY: "invalid JSON body",
    NAME_REQUIRED: "name is required",
    TYPE_REQUIRED: "type is required",
    PAYLOAD_NULL: "payload must not be null",
    EMPTY_BATCH: "batch must not be empty",
    BATCH_TOO_LARGE: "batch size must not exceed 1000",
    INVALID_TASK_ID: "invalid task id",
    INVALID_DLQ_TASK_ID: "invalid dlq task id",
}

# Histogram upper bounds.
BUCKETS = {
    "task_duration": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0),
    "flush_latency": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0),
    "flush_batch_size": (1.0, 10.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0),
    "http_duration": (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0),
    "produce_latency": (0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0),
    "end_to_end": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0),
    "worker_batch_size": (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0),
}

# Metric series the text reader keeps.
METRIC_PREFIXES = (
    "worker_tasks_processed_total",
    "worker_tasks_in_progress",
    "worker_task_duration_seconds",
    "tasks_created_total",
    "kafka_produce_total",
    "kafka_consume_total",
    "kafka_consume_lag",
    "history_flush_total",
    "history_buffer_depth",
)


PAYLOAD = T.MapType(T.StringType(), T.StringType())
_HEADERS = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])
)
_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "payload": PAYLOAD,
    "headers": _HEADERS,
}


def _fields(spec: str) -> T.StructType:
    """``name type, name type, …``; readable without a session, unlike a DDL string."""
    pairs = [column.split() for column in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


TASK = _fields(
    "id string, name string, type string, payload payload, status string, priority int,"
    " retry_count int, max_retries int, timeout_seconds int, idempotency_key string,"
    " created_at timestamp, updated_at timestamp, run_after timestamp"
)
TASK_HISTORY = _fields("id string, task_id string, status string, occurred_at timestamp")
TASK_LOG = _fields("id string, task_id string, status string, occurred_at timestamp, seq bigint")
STORED_HISTORY = _fields("id string, task_id string, status string, occurred_at timestamp, seq bigint, event_month string")
DEAD_LETTER = _fields(
    "id string, original_task_id string, name string, type string, payload payload,"
    " priority int, retry_count int, max_retries int, timeout_seconds int, error_message string,"
    " original_created_at timestamp, dead_lettered_at timestamp"
)
OUTBOX = _fields("id string, task_id string, payload string, created_at timestamp, published_at timestamp")
REQUEST = _fields(
    "name string, type string, payload payload, priority int, max_retries int,"
    " timeout_seconds int, idempotency_key string"
)
OUTBOX_PAYLOAD = _fields(
    "task_id string, name string, type string, payload payload, priority int,"
    " max_retries int, timeout_seconds int, idempotency_key string"
)
TASK_MESSAGE = _fields(
    "task_id string, name string, type string, payload payload, priority int,"
    " max_retries int, timeout_seconds int, retry_count int, idempotency_key string"
)
HISTORY_MESSAGE = _fields("task_id string, status string, at string, seq bigint")
MESSAGE_ROW = _fields(
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp,"
    " headers headers"
)
# In storage a task also has the count of its changes and a log row the ordinal of its change; both may be absent.
STORED_TASK = T.StructType([*TASK.fields, T.StructField("seq", T.LongType())])
TASK_COLUMNS = tuple(TASK.fieldNames())
LOG_COLUMNS = tuple(TASK_LOG.fieldNames())


def stored_as_text(schema: T.StructType) -> T.StructType:
    """The same table with ``payload`` kept as JSON text, the form it has in storage."""
    return T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "payload" else f.dataType, f.nullable) for f in schema]
    )
