"""SQL counterparts of the registered queries, written against the same views in plain SQL."""

from __future__ import annotations

from jobtide import schemas as S
from jobtide.plans.views import DLQ_OFFSET, EVENTS_AS_OF, TASKS_AS_OF, VIEWS, with_views

ORACLES: dict[str, str] = {}
T = f"TIMESTAMP '{TASKS_AS_OF}'"
E = f"TIMESTAMP '{EVENTS_AS_OF}'"


def add(name: str, views: str, sql: str) -> None:
    """``sql`` starting with a comma goes on with the ``WITH`` list of the views."""
    ORACLES[name] = with_views(*views.split()) + sql


def uuid_of(*parts: str) -> str:
    digest = "md5(concat_ws(':', " + ", ".join(parts) + "))"
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "concat_ws('-', " + ", ".join(f"substring({digest}, {a}, {n})" for a, n in cuts) + ")"


def seconds(a: str, b: str) -> str:
    return f"(epoch_us({b}) - epoch_us({a})) / 1000000.0"


TASK_COLS = [c for c in VIEWS["tasks"][1]]

add(
    "tasks_scan",
    "tasks",
    "SELECT " + ", ".join(f'"{c}"' for c in TASK_COLS if c != "payload")
    + ", json_extract_string(payload, '$.cust') AS payload_cust FROM tasks",
)
add(
    "history_month_scan",
    "task_history",
    "SELECT *, strftime(occurred_at, '%Y-%m') AS event_month FROM task_history"
    " WHERE occurred_at >= TIMESTAMP '2024-01-10 00:00:00' AND occurred_at < TIMESTAMP '2024-01-20 12:00:00'",
)
add(
    "month_layout_counts",
    "task_history",
    "SELECT strftime(occurred_at, '%Y-%m') AS event_month, status, count(*) AS n FROM task_history GROUP BY 1, 2",
)
add(
    "outbox_scan",
    "outbox",
    "SELECT id, task_id, CAST(json_extract_string(payload, '$.k') AS INT) AS k, published_at IS NULL AS pending FROM outbox",
)

# Which messages are broken follows from the rule that made them, not from parsing them again.
_BAD = "CASE event_id % 10 WHEN 3 THEN 'bad_json' WHEN 7 THEN 'bad_json' WHEN 5 THEN 'bad_task_id' ELSE 'ok' END"
add("message_parse_outcomes", "messages", f"SELECT topic, {_BAD} AS outcome, count(*) AS n FROM messages GROUP BY 1, 2")
add(
    "message_parse_fields",
    "messages",
    "SELECT json_extract_string(task_value, '$.task_id') AS task_id, json_extract_string(task_value, '$.name') AS name,"
    " json_extract_string(task_value, '$.type') AS type, CAST(json_extract_string(task_value, '$.priority') AS INT) AS priority,"
    " CAST(json_extract_string(task_value, '$.retry_count') AS INT) AS retry_count,"
    " json_extract_string(task_value, '$.payload.k') AS payload_k, CAST(\"partition\" AS VARCHAR) AS meta_partition,"
    " CAST(\"offset\" AS VARCHAR) AS meta_offset, topic AS meta_topic"
    " FROM messages WHERE event_id % 10 NOT IN (3, 5, 7)",
)
add(
    "message_quarantine",
    "messages",
    f"SELECT topic, \"partition\", \"offset\", task_value AS value, {_BAD} AS reject_reason FROM messages WHERE {_BAD} <> 'ok'",
)
add(
    "history_parse_outcomes",
    "messages",
    "SELECT CASE event_id % 10 WHEN 3 THEN 'bad_json' WHEN 5 THEN 'bad_task_id' ELSE 'ok' END AS outcome,"
    " CASE event_id % 10 WHEN 3 THEN '' WHEN 5 THEN 'queued' WHEN 7 THEN 'queued' ELSE 'running' END AS status,"
    " count(*) AS n, CAST(sum(CASE WHEN event_id % 10 = 5 THEN CASE WHEN \"timestamp\" = TIMESTAMP '2024-01-01 00:00:00' THEN 1 ELSE 0 END ELSE 1 END) AS BIGINT) AS at_record_time"
    " FROM messages GROUP BY 1, 2",
)
_WIRE = (
    "concat('{{\"task_id\":\"', CAST(id AS VARCHAR), '\",\"name\":\"', name, '\",\"type\":\"', type, '\",\"payload\":', payload,"
    " ',\"priority\":', CAST(priority AS VARCHAR), ',\"max_retries\":', CAST(max_retries AS VARCHAR),"
    " ',\"timeout_seconds\":', CAST(timeout_seconds AS VARCHAR){retry}{key}, '}}')"
)
_RETRY = ", ',\"retry_count\":', CAST(retry_count AS VARCHAR)"
_KEY = ", CASE WHEN idempotency_key IS NULL THEN '' ELSE concat(',\"idempotency_key\":\"', idempotency_key, '\"') END"
add(
    "message_encode",
    "tasks",
    f"SELECT type AS key, {_WIRE.format(retry=_RETRY, key='')} AS value, CAST(id AS VARCHAR) AS h_task_id,"
    " CAST(retry_count AS VARCHAR) AS h_retry_count, 'tasks' AS topic FROM tasks",
)
add(
    "dlq_message_encode",
    "tasks",
    f"SELECT type AS key, {_WIRE.format(retry=_RETRY, key='')} AS value, CAST(id AS VARCHAR) AS h_task_id,"
    " concat('error ', CAST(retry_count AS VARCHAR)) AS h_error, 'tasks-dlq' AS topic FROM tasks WHERE status = 'dead_lettered'",
)
add(
    "history_encode",
    "task_history",
    "SELECT CAST(task_id AS VARCHAR) AS key, concat('{\"task_id\":\"', CAST(task_id AS VARCHAR), '\",\"status\":\"', status,"
    " '\",\"at\":\"', replace(rtrim(rtrim(strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), ' ', 'T'), 'Z\"}') AS value,"
    " 'task-history' AS topic FROM task_history",
)
add(
    "outbox_build",
    "tasks",
    f"SELECT {uuid_of(chr(39) + 'outbox' + chr(39), 'CAST(id AS VARCHAR)', chr(39) + TASKS_AS_OF + chr(39))} AS id, id AS task_id,"
    f" {_WIRE.format(retry='', key='')} AS payload, {T} AS created_at, CAST(NULL AS TIMESTAMP) AS published_at"
    " FROM tasks WHERE status = 'queued'",
)
add(
    "header_ops",
    "samples",
    "SELECT \"index\", upper(kind) AS kind, concat('t', CAST(\"index\" AS VARCHAR)) AS trace, '' AS absent,"
    " 'kind,index,trace' AS keys FROM samples",
)
add(
    "request_parse",
    "messages",
    "SELECT event_id, event_id % 10 NOT IN (3, 7) AS json_ok,"
    " CASE event_id % 10 WHEN 3 THEN '' ELSE coalesce(json_extract_string(task_value, '$.name'), '') END AS name,"
    " CASE event_id % 10 WHEN 3 THEN '' ELSE coalesce(json_extract_string(task_value, '$.type'), '') END AS type,"
    " CASE WHEN event_id % 10 IN (3, 5, 7) THEN 0 ELSE CAST(event_id % 9 AS INT) END AS priority,"
    " CASE event_id % 10 WHEN 3 THEN NULL ELSE json_extract_string(task_value, '$.payload.k') END AS payload_k FROM messages",
)
ORACLES["request_parse"] = ORACLES["request_parse"].replace(
    "json_extract_string(task_value", "json_extract_string(CASE WHEN json_valid(task_value) THEN task_value END"
)
ORACLES["message_parse_fields"] = ORACLES["message_parse_fields"].replace(
    "json_extract_string(task_value", "json_extract_string(CASE WHEN json_valid(task_value) THEN task_value END"
)
add(
    "request_key_case",
    "messages",
    "SELECT event_id, event_id % 4 <> 3 AS json_ok,"
    " concat(CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END, CAST(event_id AS VARCHAR)) AS name,"
    " CASE event_id % 4 WHEN 1 THEN 'run_query' WHEN 3 THEN '5' ELSE 'noop' END AS type,"
    " CAST(CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END AS INT) AS priority,"
    " CAST(CASE event_id % 4 WHEN 2 THEN 9 ELSE 0 END AS INT) AS max_retries,"
    " CASE event_id % 4 WHEN 0 THEN 'low' WHEN 2 THEN 'two' END AS payload_k FROM messages",
)
add(
    "metric_text_parse",
    "samples",
    "SELECT 'tasks_created_total' AS name, kind AS type, count(*) AS n, CAST(sum(\"index\") AS DOUBLE) AS sample_sum"
    " FROM samples WHERE \"index\" % 7 NOT IN (0, 1) GROUP BY kind",
)
add(
    "task_id_check",
    "access_log",
    "SELECT CASE WHEN path LIKE '%0000-4000%' THEN regexp_extract(path, '([0-9a-f]{8}-[0-9a-f-]{27})', 1) END AS task_id,"
    " CASE WHEN path LIKE '%0000-4000%' THEN NULL ELSE 'INVALID_TASK_ID' END AS code, count(*) AS n FROM access_log GROUP BY 1, 2",
)
add(
    "request_defaults",
    "task_requests",
    "SELECT id, CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS max_retries,"
    " CASE WHEN timeout_seconds = 0 THEN 30 ELSE timeout_seconds END AS timeout_seconds,"
    " nullif(idempotency_key, '') AS idempotency_key, 'queued' AS status, 0 AS retry_count,"
    f" {T} AS created_at, {T} AS run_after FROM task_requests",
)
_CODE = (
    "CASE WHEN name = '' THEN 'NAME_REQUIRED' WHEN type = '' THEN 'TYPE_REQUIRED'"
    " WHEN type NOT IN ('send_email', 'run_query', 'noop') THEN 'UNKNOWN_TASK_TYPE'"
    " WHEN payload IS NULL THEN 'PAYLOAD_NULL' ELSE 'OK' END"
)
_MESSAGE = (
    "CASE code WHEN 'NAME_REQUIRED' THEN 'name is required' WHEN 'TYPE_REQUIRED' THEN 'type is required'"
    " WHEN 'UNKNOWN_TASK_TYPE' THEN concat('unknown task type \"', type, '\"')"
    " WHEN 'PAYLOAD_NULL' THEN 'payload must not be null' END"
)
_CHECKED = f"checked AS (SELECT *, {_CODE} AS code FROM task_requests)"
add("request_validation", "task_requests", f", {_CHECKED} SELECT id, code, {_MESSAGE} AS message FROM checked")
add("known_type_filter", "task_requests", "SELECT id, type FROM task_requests WHERE type NOT IN ('send_email', 'run_query', 'noop')")
_BATCHES = (
    f"{_CHECKED}, ranked AS (SELECT *, {_MESSAGE} AS message, count(*) OVER (PARTITION BY batch_id) AS size,"
    " row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN code = 'OK' THEN 1 ELSE 0 END, id) AS rn FROM checked)"
)
_PASSED = "size <= 1000 AND code = 'OK'"
add(
    "batch_validation",
    "task_requests",
    f", {_BATCHES} SELECT batch_id, size, CASE WHEN size > 1000 THEN 'BATCH_TOO_LARGE' ELSE code END AS code,"
    " CASE WHEN size > 1000 OR code = 'OK' THEN NULL ELSE id END AS bad_idx,"
    " CASE WHEN size > 1000 THEN 'batch size must not exceed 1000' WHEN code = 'OK' THEN NULL"
    " ELSE concat('task[', CAST(id AS VARCHAR), ']: ', message) END AS message FROM ranked WHERE rn = 1",
)
add(
    "batch_create",
    "task_requests",
    f", {_BATCHES}, good AS (SELECT r.* FROM ranked r WHERE batch_id IN (SELECT batch_id FROM ranked WHERE rn = 1 AND {_PASSED})),"
    " firsts AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN idempotency_key = '' THEN CAST(id AS VARCHAR)"
    " ELSE concat('key ', idempotency_key) END ORDER BY batch_id, id) AS k FROM good)"
    " SELECT id, type, CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS max_retries,"
    " CASE WHEN timeout_seconds = 0 THEN 30 ELSE timeout_seconds END AS timeout_seconds,"
    " nullif(idempotency_key, '') AS idempotency_key, 'queued' AS status FROM firsts WHERE k = 1",
)


def resolved(source: str) -> str:
    """Owner of every key, by a window over the requests and a lookup of the stored keys."""
    return (
        f"keyed AS (SELECT r.*, nullif(r.idempotency_key, '') AS k FROM {source} r),"
        " owned AS (SELECT keyed.*, s.id AS stored_id, CASE WHEN k IS NULL THEN keyed.id ELSE first_value(keyed.id) OVER"
        " (PARTITION BY k ORDER BY requested_at, keyed.id) END AS first_id"
        " FROM keyed LEFT JOIN stored_keys s ON s.idempotency_key = keyed.k),"
        " resolved AS (SELECT owned.*, coalesce(stored_id, first_id) AS task_id, CASE WHEN stored_id IS NULL AND first_id = id"
        " THEN 'CREATED' ELSE 'EXISTING' END AS outcome FROM owned)"
    )


add(
    "idempotency_resolve",
    "task_requests stored_keys",
    f", {resolved('task_requests')} SELECT id, k AS idempotency_key, task_id, outcome FROM resolved",
)
_VALID = f"{_CHECKED}, valid AS (SELECT * FROM checked WHERE code = 'OK'), {resolved('valid')}"
_COMPLETED = (
    "made AS (SELECT id, name, type, payload, 'queued' AS status, priority, 0 AS retry_count,"
    " CASE WHEN max_retries = 0 THEN 3 ELSE max_retries END AS max_retries,"
    " CASE WHEN timeout_seconds = 0 THEN 30 ELSE timeout_seconds END AS timeout_seconds, k AS idempotency_key,"
    f" {T} AS created_at, {T} AS updated_at, {T} AS run_after FROM resolved WHERE outcome = 'CREATED')"
)
add("create_tasks", "task_requests stored_keys", f", {_VALID}, {_COMPLETED} SELECT * FROM made")
add(
    "create_outcomes",
    "task_requests stored_keys",
    f", {_VALID} SELECT id, code, CAST(NULL AS VARCHAR) AS message, task_id, outcome FROM resolved"
    f" UNION ALL SELECT id, code, {_MESSAGE}, NULL, 'REJECTED' FROM checked WHERE code <> 'OK'",
)
add(
    "create_deltas",
    "task_requests stored_keys",
    f", {_VALID}, {_COMPLETED} SELECT 'history' AS part, id AS task_id, 'queued' AS body, created_at AS at FROM made"
    f" UNION ALL SELECT 'outbox', id, {_WIRE.format(retry='', key=_KEY)}, created_at FROM made",
)

_ASKED = "asked AS (SELECT DISTINCT l_orderkey * 2 AS id FROM lineitem)"
add(
    "task_lookup",
    "tasks",
    f", {_ASKED} SELECT asked.id, tasks.id IS NOT NULL AS found, status, priority FROM asked LEFT JOIN tasks ON tasks.id = asked.id",
)
add(
    "dlq_lookup",
    "dead_letters",
    f", {_ASKED} SELECT asked.id + {DLQ_OFFSET} AS id, d.id IS NOT NULL AS found, d.original_task_id, d.error_message"
    f" FROM asked LEFT JOIN dead_letters d ON d.id = asked.id + {DLQ_OFFSET}",
)
_TERMINAL = "('succeeded', 'failed', 'dead_lettered')"
_FLAGGED = (
    "flagged AS (SELECT l_orderkey * 2 AS task_id, coalesce(tasks.status IN " + _TERMINAL + ", false) AS skip"
    " FROM lineitem LEFT JOIN tasks ON tasks.id = l_orderkey * 2)"
)
add("skip_terminal", "tasks", f", {_FLAGGED} SELECT task_id, skip, count(*) AS n FROM flagged GROUP BY 1, 2")
add("skipped_count", "tasks", f", {_FLAGGED} SELECT count(*) FILTER (WHERE skip) AS skipped, count(*) AS delivered FROM flagged")
add(
    "history_for_tasks",
    "tasks task_history",
    ", asked AS (SELECT c_custkey * 11 AS task_id FROM customer)"
    " SELECT a.task_id, t.id IS NOT NULL AS task_exists, h.id, h.status, h.occurred_at FROM asked a"
    " LEFT JOIN tasks t ON t.id = a.task_id LEFT JOIN task_history h ON h.task_id = t.id",
)
add("task_timeline", "task_history", "SELECT * FROM task_history ORDER BY task_id, occurred_at, id")
add(
    "orphan_history",
    "tasks task_history",
    "SELECT id, task_id, status FROM task_history h WHERE NOT EXISTS"
    " (SELECT 1 FROM tasks t WHERE t.id = h.task_id AND t.status <> 'queued')",
)
add(
    "orphan_dlq",
    "dead_letters",
    "SELECT id, original_task_id FROM dead_letters d WHERE NOT EXISTS"
    " (SELECT 1 FROM tasks t WHERE t.id = d.original_task_id AND t.retry_count > 0)",
)

_CLAIM = (
    f"claim AS (SELECT *, row_number() OVER (ORDER BY priority DESC, created_at, id) AS claim_rank FROM tasks"
    f" WHERE status = 'queued' AND run_after <= {T})"
)
add("claim_topk", "tasks", f", {_CLAIM} SELECT id, priority, created_at FROM claim WHERE claim_rank <= 100")
add(
    "claim_assign",
    "tasks",
    f", {_CLAIM} SELECT id, CAST(claim_rank AS INT) AS claim_rank, CAST((claim_rank - 1) % 8 AS INT) AS worker,"
    f" 'running' AS status, {T} AS updated_at FROM claim WHERE claim_rank <= 100",
)
add(
    "set_status",
    "tasks",
    ", ranked AS (SELECT l_orderkey * 2 AS id, lower(l_linestatus) AS status, row_number() OVER (PARTITION BY l_orderkey"
    " ORDER BY l_linenumber DESC, l_partkey DESC, lower(l_linestatus) DESC) AS rn FROM lineitem),"
    f" after AS (SELECT coalesce(r.status, t.status) AS status, CASE WHEN r.id IS NULL THEN t.updated_at ELSE {T} END AS updated_at"
    " FROM tasks t LEFT JOIN ranked r ON r.id = t.id AND r.rn = 1) SELECT status, updated_at, count(*) AS n FROM after GROUP BY 1, 2",
)
_CHANGES = (
    "changes AS (SELECT id, p AS place, CASE WHEN p = 1 THEN 'running' WHEN p = 3 AND id % 10 = 0 THEN 'succeeded' ELSE 'queued' END AS status"
    " FROM tasks, (VALUES (1), (2), (3)) AS t(p) WHERE id % 5 = 0)"
)
_LOG_ID = uuid_of("CAST(id AS VARCHAR)", "status", f"'{TASKS_AS_OF}'", "CAST(place AS VARCHAR)")
add(
    "set_status_repeated",
    "tasks",
    f", {_CHANGES} SELECT 'log' AS part, {_LOG_ID} AS id, id AS task_id, status, CAST(place AS BIGINT) AS seq FROM changes"
    " UNION ALL SELECT 'table', NULL, id, status, CAST(3 AS BIGINT) FROM changes WHERE place = 3",
)
add(
    "apply_transitions_repeated",
    "tasks",
    "SELECT id, CASE WHEN id % 3 = 0 THEN upper(status) ELSE status END AS status,"
    " CASE WHEN id % 3 = 0 THEN 'new' ELSE json_extract_string(payload, '$.cust') END AS payload_cust,"
    " CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS seq FROM tasks",
)
add(
    "fold_at_one_instant",
    "tasks",
    ", after AS (SELECT CASE WHEN id % 10 = 0 THEN 'succeeded' WHEN id % 5 = 0 OR id % 6 = 0 THEN 'queued' WHEN id % 3 = 0"
    " THEN 'dead_lettered' ELSE status END AS status, id % 5 = 0 OR id % 3 = 0 AS hit FROM tasks)"
    " SELECT status, count(*) AS n, count(*) FILTER (WHERE hit) AS moved, CAST(0 AS BIGINT) AS apart FROM after GROUP BY 1",
)
_BACKOFF = "CAST(least(5 * power(2, retry_count), 300) AS INT)"
add(
    "requeue_backoff",
    "tasks",
    f"SELECT id, 'queued' AS status, retry_count + 1 AS retry_count, {T} AS updated_at,"
    f" {T} + INTERVAL '1' SECOND * {_BACKOFF} AS run_after FROM tasks WHERE status = 'running'",
)
_DLQ_ID = uuid_of("'dlq'", "CAST(id AS VARCHAR)", f"'{TASKS_AS_OF}'")
add(
    "dlq_snapshot",
    "tasks",
    f"SELECT {_DLQ_ID} AS id, id AS original_task_id, name, type, payload, priority, retry_count, max_retries, timeout_seconds,"
    f" concat('boom ', CAST(id AS VARCHAR)) AS error_message, created_at AS original_created_at, {T} AS dead_lettered_at"
    " FROM tasks WHERE status = 'running' AND id % 3 = 0",
)
_STALE = (
    "stale AS (SELECT *, CASE WHEN retry_count < max_retries THEN 'requeued' ELSE 'dead_lettered' END AS outcome FROM tasks"
    f" WHERE status = 'running' AND updated_at + INTERVAL '1' SECOND * timeout_seconds < {T})"
)
add("reap_plan", "tasks", f", {_STALE} SELECT id, retry_count, outcome FROM stale")
add(
    "reap_counts",
    "tasks",
    f", {_STALE} SELECT 'requeued' AS outcome, count(*) FILTER (WHERE outcome = 'requeued') AS n FROM stale"
    " UNION ALL SELECT 'dead_lettered', count(*) FILTER (WHERE outcome = 'dead_lettered') FROM stale",
)
add(
    "reap_deltas",
    "tasks",
    f", {_STALE} SELECT 'dlq' AS part, id AS task_id, '{S.REAPED_MESSAGE}' AS body FROM stale WHERE outcome = 'dead_lettered'"
    " UNION ALL SELECT 'history', id, CASE WHEN outcome = 'requeued' THEN 'queued' ELSE 'dead_lettered' END FROM stale",
)
_AFTER_REAP = (
    f"{_STALE}, after AS (SELECT t.id, CASE s.outcome WHEN 'requeued' THEN 'queued' WHEN 'dead_lettered' THEN 'dead_lettered'"
    " ELSE t.status END AS status, t.retry_count + CASE WHEN s.outcome = 'requeued' THEN 1 ELSE 0 END AS retry_count,"
    f" CASE WHEN s.id IS NULL THEN t.updated_at ELSE {T} END AS updated_at,"
    f" CASE WHEN s.outcome = 'requeued' THEN {T} ELSE t.run_after END AS run_after"
    " FROM tasks t LEFT JOIN stale s ON s.id = t.id)"
)
add("apply_transitions", "tasks", f", {_AFTER_REAP} SELECT * FROM after")
_RETRIED = (
    f"asked AS (SELECT c_custkey * 3 + {DLQ_OFFSET} AS id FROM customer),"
    " chosen AS (SELECT d.* FROM dead_letters d WHERE d.id IN (SELECT id FROM asked))"
)
add(
    "dlq_retry",
    "dead_letters",
    f", {_RETRIED} SELECT original_task_id AS id, 'queued' AS status, 0 AS retry_count, {T} AS updated_at, {T} AS run_after FROM chosen",
)
add(
    "dlq_retry_remaining",
    "dead_letters",
    f", {_RETRIED} SELECT 'left' AS part, id FROM dead_letters WHERE id NOT IN (SELECT id FROM asked)"
    " UNION ALL SELECT 'not_found', id FROM asked WHERE id NOT IN (SELECT id FROM dead_letters)",
)
_OUTCOME = (
    "CASE WHEN type = 'noop' THEN 'failed' WHEN id % 3 <> 0 THEN 'succeeded' WHEN retry_count < max_retries THEN 'retry'"
    " ELSE 'dead_lettered' END"
)
add(
    "failure_route",
    "tasks",
    f", routed AS (SELECT *, {_OUTCOME} AS outcome FROM tasks WHERE status = 'running')"
    " SELECT id, CASE WHEN outcome = 'retry' THEN 'queued' ELSE outcome END AS status,"
    " CASE WHEN outcome = 'retry' THEN retry_count + 1 ELSE retry_count END AS retry_count,"
    f" {T} AS updated_at, CASE WHEN outcome = 'retry' THEN {T} + INTERVAL '1' SECOND * {_BACKOFF} ELSE run_after END AS run_after,"
    " outcome FROM routed",
)
add(
    "lifecycle_tick",
    "tasks",
    f", {_CLAIM}, {_STALE}, moved AS (SELECT 'claimed' AS outcome FROM claim WHERE claim_rank <= 100"
    " UNION ALL SELECT outcome FROM stale) SELECT outcome, count(*) AS n FROM moved GROUP BY outcome",
)
add(
    "tick_status_counts",
    "tasks",
    f", {_CLAIM}, {_AFTER_REAP} SELECT CASE WHEN c.id IS NULL THEN a.status ELSE 'running' END AS status, count(*) AS n"
    " FROM after a LEFT JOIN claim c ON c.id = a.id AND c.claim_rank <= 100 GROUP BY 1",
)
add(
    "execute_handlers",
    "tasks",
    "SELECT id, type, type = 'run_query' OR (type = 'send_email' AND payload NOT LIKE '%7\"}') AS ok,"
    " CASE WHEN type = 'send_email' AND payload LIKE '%7\"}' THEN concat('refused ', json_extract_string(payload, '$.cust')) END AS error,"
    " type <> 'noop' AS known_type FROM tasks WHERE status = 'running'",
)

_POLL = (
    "poll AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS rn FROM outbox WHERE published_at IS NULL)"
)
add("outbox_poll", "outbox", f", {_POLL} SELECT id, task_id, payload, created_at FROM poll WHERE rn <= 500")
add("outbox_depth", "outbox", "SELECT count(*) AS depth FROM outbox WHERE published_at IS NULL")
add(
    "outbox_prune",
    "outbox",
    f"SELECT id, published_at FROM outbox WHERE published_at IS NULL OR published_at >= {E} - INTERVAL '3600' SECOND",
)
add(
    "outbox_mark_published",
    "outbox",
    f", {_POLL} SELECT o.id, CASE WHEN p.id IS NULL THEN o.published_at ELSE TIMESTAMP '2024-02-01 00:00:00' END AS published_at"
    " FROM outbox o LEFT JOIN poll p ON p.id = o.id AND p.rn <= 500",
)
add("dlq_list", "dead_letters", "SELECT * FROM dead_letters ORDER BY dead_lettered_at DESC, id")
add(
    "monitor_sample",
    "samples",
    'SELECT "index", latency_seconds FROM samples WHERE error = \'\' ORDER BY "index" LIMIT 10000',
)
add("retention", "task_history", f"SELECT * FROM task_history WHERE occurred_at >= {E} - INTERVAL '604800' SECOND")
_OLD = "old AS (SELECT id, status, retry_count, updated_at, run_after FROM tasks)"
add(
    "snapshot_diff",
    "tasks",
    f", {_AFTER_REAP}, {_OLD} SELECT *, 'lost' AS change, CAST(1 AS BIGINT) AS times FROM (SELECT * FROM old EXCEPT SELECT * FROM after)"
    " UNION ALL SELECT *, 'gained', CAST(1 AS BIGINT) FROM (SELECT * FROM after EXCEPT SELECT * FROM old)",
)

add(
    "current_state",
    "task_history",
    "SELECT task_id, status, occurred_at, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id"
    " ORDER BY occurred_at DESC, id DESC) AS rn FROM task_history) WHERE rn = 1",
)
_ORDER = "OVER (PARTITION BY task_id ORDER BY occurred_at, id)"
_STEPS = (
    f"steps AS (SELECT *, lag(status) {_ORDER} AS prev_status, lag(occurred_at) {_ORDER} AS prev_at,"
    f" lead(status) {_ORDER} AS next_status, lead(occurred_at) {_ORDER} AS next_at FROM task_history)"
)
add(
    "transition_steps",
    "task_history",
    f", {_STEPS} SELECT id, task_id, status, prev_status, round({seconds('prev_at', 'occurred_at')}, 3) AS gap_seconds FROM steps",
)
add(
    "next_steps",
    "task_history",
    f", {_STEPS} SELECT id, status, next_status, round({seconds('occurred_at', 'next_at')}, 3) AS gap_seconds FROM steps",
)
_LEGAL = "(" + ", ".join(f"'{a}>{b}'" for a, b in S.LEGAL_TRANSITIONS) + ")"
_PAIR = "concat(coalesce(prev_status, 'start'), '>', status)"
add(
    "transition_matrix",
    "task_history",
    f", {_STEPS} SELECT coalesce(prev_status, 'start') AS prev_status, status, count(*) AS n, {_PAIR} IN {_LEGAL} AS legal"
    " FROM steps GROUP BY 1, 2, 4",
)
add(
    "lifecycle_audit",
    "task_history",
    f", {_STEPS} SELECT id, task_id, coalesce(prev_status, 'start') AS prev_status, status FROM steps WHERE {_PAIR} NOT IN {_LEGAL}",
)
_CYCLES = (
    f"cycles AS (SELECT *, CAST(coalesce(sum(CASE WHEN status IN {_TERMINAL} THEN 1 ELSE 0 END) OVER (PARTITION BY task_id"
    " ORDER BY occurred_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cycle FROM task_history)"
)
add(
    "attempts",
    "task_history",
    f", {_CYCLES} SELECT id, task_id, status, cycle, CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY task_id, cycle ORDER BY occurred_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM cycles",
)
add(
    "queue_wait",
    "task_history",
    f", {_STEPS} SELECT task_id, occurred_at AS started_at, round({seconds('prev_at', 'occurred_at')}, 3) AS wait_seconds"
    " FROM steps WHERE prev_status = 'queued' AND status = 'running'",
)
add(
    "execution_duration",
    "task_history tasks",
    f", {_STEPS}, runs AS (SELECT task_id, CASE status WHEN 'queued' THEN 'retry' ELSE status END AS outcome,"
    f" {seconds('prev_at', 'occurred_at')} AS d FROM steps WHERE prev_status = 'running' AND status IN ('succeeded', 'queued', 'dead_lettered'))"
    " SELECT t.type, outcome, count(*) AS n, round(min(d), 3) AS shortest, round(max(d), 3) AS longest"
    " FROM runs LEFT JOIN tasks t ON t.id = runs.task_id GROUP BY 1, 2",
)
add(
    "e2e_latency",
    "task_history tasks",
    f", {_CYCLES}, ends AS (SELECT task_id, cycle, min(occurred_at) FILTER (WHERE status = 'queued') AS created_at,"
    f" min(occurred_at) FILTER (WHERE status IN {_TERMINAL}) AS finished_at,"
    f" min(status) FILTER (WHERE status IN {_TERMINAL}) AS status FROM cycles GROUP BY 1, 2)"
    " SELECT task_id, cycle, t.type, ends.status, ends.created_at, finished_at,"
    f" round({seconds('ends.created_at', 'finished_at')}, 3) AS e2e_seconds FROM ends LEFT JOIN tasks t ON t.id = task_id"
    " WHERE ends.created_at IS NOT NULL AND finished_at IS NOT NULL",
)

_TIED = "tied AS (SELECT id, task_id, status, date_trunc('hour', occurred_at) AS occurred_at, CAST(id * 7 % 5 AS BIGINT) AS seq FROM task_history)"
add(
    "current_state_ties",
    "task_history",
    f", {_TIED} SELECT task_id, status, occurred_at, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id"
    " ORDER BY occurred_at DESC, seq DESC, id DESC) AS rn FROM tied) WHERE rn = 1",
)
add(
    "audit_ties",
    "task_history",
    f", {_TIED}, {_STEPS.replace('occurred_at, id', 'occurred_at, seq, id').replace('task_history', 'tied')}"
    f" SELECT id, task_id, coalesce(prev_status, 'start') AS prev_status, status FROM steps WHERE {_PAIR} NOT IN {_LEGAL}",
)
add(
    "attempts_ties",
    "task_history",
    f", {_TIED}, {_CYCLES.replace('occurred_at, id', 'occurred_at, seq, id').replace('task_history', 'tied')}"
    " SELECT id, task_id, status, cycle, CAST(sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) OVER"
    " (PARTITION BY task_id, cycle ORDER BY occurred_at, seq, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM cycles",
)

add("terminal_counts", "tasks", f"SELECT status, status IN {_TERMINAL} AS terminal, count(*) AS n FROM tasks GROUP BY 1, 2")
add("status_breakdown", "tasks", "SELECT status, count(*) AS n FROM tasks GROUP BY status ORDER BY status")
add(
    "completion_summary",
    "tasks",
    "SELECT count(*) FILTER (WHERE status = 'succeeded') AS completed,"
    " count(*) FILTER (WHERE status IN ('failed', 'dead_lettered')) AS failed,"
    " count(*) FILTER (WHERE status IN ('queued', 'running')) AS stuck FROM tasks",
)
add("dlq_depth", "dead_letters", "SELECT count(*) AS depth FROM dead_letters")


def series(change: str) -> str:
    return (
        f", {_STEPS}, moves AS (SELECT date_trunc('hour', occurred_at) AS step_start, {change} AS c FROM steps),"
        " totals AS (SELECT step_start, CAST(sum(c) AS BIGINT) AS delta FROM moves WHERE c <> 0 GROUP BY 1)"
        " SELECT step_start, delta, CAST(sum(delta) OVER (ORDER BY step_start) AS BIGINT) AS depth FROM totals"
    )


add(
    "dlq_depth_series",
    "task_history",
    series(
        "CASE WHEN status = 'dead_lettered' THEN 1 WHEN status = 'queued' AND prev_status = 'dead_lettered' THEN -1 ELSE 0 END"
    ),
)
add("in_progress", "tasks", "SELECT count(*) AS in_progress FROM tasks WHERE status = 'running'")
add(
    "in_progress_series",
    "task_history",
    series("CASE WHEN status = 'running' THEN 1 ELSE 0 END - CASE WHEN coalesce(prev_status, '') = 'running' THEN 1 ELSE 0 END"),
)
add(
    "created_by_type",
    "task_requests stored_keys",
    f", {resolved('task_requests')} SELECT CASE WHEN batch_id = 0 THEN 'batch' ELSE type END AS type, count(*) AS created"
    " FROM resolved WHERE outcome = 'CREATED' GROUP BY 1",
)
add(
    "processed_by_type_status",
    "tasks",
    f", routed AS (SELECT *, {_OUTCOME} AS outcome FROM tasks WHERE status = 'running')"
    " SELECT type, outcome AS status, count(*) AS processed FROM routed WHERE outcome <> 'failed' GROUP BY 1, 2",
)
add(
    "requests_by_route",
    "access_log",
    "SELECT method, regexp_replace(path, '[0-9]{8}-[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{12}', '{id}') AS route, status,"
    " count(*) AS requests FROM access_log GROUP BY 1, 2, 3",
)
add(
    "severity_counts",
    "access_log",
    "SELECT CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warn' ELSE 'info' END AS severity,"
    " count(*) AS requests FROM access_log GROUP BY 1",
)
add(
    "error_rate",
    "samples",
    "SELECT CAST(seen_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE error <> '') AS errors,"
    " round(100.0 * count(*) FILTER (WHERE error <> '') / count(*), 6) AS error_rate FROM samples GROUP BY 1",
)
add(
    "throughput",
    "samples",
    f", totals AS (SELECT count(*) FILTER (WHERE error = '') AS n, {seconds('min(seen_at)', 'max(seen_at)')} AS s FROM samples)"
    " SELECT n, round(s, 3) AS span_seconds, round(n / s, 9) AS per_second FROM totals",
)


def percentiles(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    picks = ", ".join(
        f"floor(max(CASE WHEN rn = greatest(ceil(n * {p} / 100), 1) THEN v END) * 1000 + 0.000001) / 1000 AS {label}"
        for p, label in (("50.0", "p50"), ("95.0", "p95"), ("99.0", "p99"), ("CAST(99.9 AS DOUBLE)", "p999"))
    )
    return (
        f", ranked AS (SELECT {lead}latency_seconds AS v, row_number() OVER ({part} ORDER BY latency_seconds) AS rn,"
        f" count(*) OVER ({part}) AS n FROM samples) SELECT {lead}max(n) AS n, {picks} FROM ranked"
        + (f" GROUP BY {by}" if by else "")
    )


add("latency_percentiles", "samples", percentiles("kind"))
add("latency_percentiles_overall", "samples", percentiles(""))
_BOUNDS = ", ".join(f"({b})" for b in S.BUCKETS["task_duration"]) + ", ('Infinity')"
_HIST = (
    f"bounds AS (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b)),"
    " hist AS (SELECT kind, le, count(*) FILTER (WHERE latency_seconds <= le) AS cumulative, count(*) AS total,"
    " sum(latency_seconds) AS value_sum FROM samples, bounds GROUP BY 1, 2)"
).replace("('Infinity')", "(CAST('Infinity' AS DOUBLE))")
add("duration_histogram", "samples", f", {_HIST} SELECT kind, le, cumulative, total, round(value_sum, 2) AS value_sum FROM hist")


def quantile(q: str) -> str:
    return (
        f", {_HIST}, steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS bef,"
        f" {q} * total AS r FROM hist WINDOW w AS (PARTITION BY kind ORDER BY le)),"
        " first AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY le) AS rn FROM steps WHERE cumulative >= r)"
        " SELECT kind, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (r - bef) / (cumulative - bef) END, 9) AS quantile"
        " FROM first WHERE rn = 1"
    )


add("histogram_p95", "samples", quantile("CAST(0.95 AS DOUBLE)"))
add("histogram_p25", "samples", quantile("CAST(0.25 AS DOUBLE)"))
add(
    "event_rate",
    "samples",
    "SELECT date_trunc('minute', seen_at) AS window_start, kind, count(*) AS events, round(count(*) / 60.0, 9) AS per_second"
    " FROM samples GROUP BY 1, 2",
)
add(
    "live_rate",
    "samples",
    ", steps AS (SELECT time_bucket(INTERVAL '2 hours', seen_at, TIMESTAMP '1970-01-01 00:00:00') AS s, count(*) AS sent,"
    " count(*) FILTER (WHERE error <> '') AS err FROM samples GROUP BY 1),"
    " runs AS (SELECT s + INTERVAL '2' HOUR AS step_end, CAST(sum(sent) OVER w AS BIGINT) AS sent, CAST(sum(err) OVER w AS BIGINT) AS err,"
    f" (sent - err) / 7200.0 AS current_rate, {seconds('min(s) OVER w', '(s + INTERVAL ' + chr(39) + '2' + chr(39) + ' HOUR)')} AS elapsed"
    " FROM steps WINDOW w AS (ORDER BY s ROWS UNBOUNDED PRECEDING))"
    " SELECT step_end, sent, sent - err AS ok, err, round(current_rate, 9) AS current_rate,"
    " round((sent - err) / elapsed, 9) AS overall_rate FROM runs",
)
ORACLES["live_rate_default"] = (
    ORACLES["live_rate"].replace("INTERVAL '2 hours'", "INTERVAL '2 seconds'").replace("INTERVAL '2' HOUR", "INTERVAL '2' SECOND").replace("7200.0", "2.0")
)
add(
    "consumer_lag",
    "messages",
    f", commits AS (SELECT topic, \"partition\", max(\"offset\") + 1 AS committed FROM messages WHERE \"timestamp\" < {E}"
    ' AND topic <> \'tasks-dlq\' GROUP BY 1, 2), ends AS (SELECT topic, "partition", max("offset") + 1 AS end_offset FROM messages GROUP BY 1, 2)'
    ' SELECT e.topic, e."partition", end_offset, committed, end_offset - coalesce(committed, 0) AS lag,'
    f" end_offset - coalesce(committed, 0) > {S.LAG_ALERT_THRESHOLD} AS over_threshold"
    ' FROM ends e LEFT JOIN commits c ON c.topic = e.topic AND c."partition" = e."partition"',
)
add("message_counts", "messages", "SELECT topic, status, count(*) AS messages FROM messages GROUP BY 1, 2")


def bucket_values(name: str) -> str:
    return ", ".join(f"(CAST({b} AS DOUBLE))" for b in S.BUCKETS[name]) + ", (CAST('Infinity' AS DOUBLE))"


_FLUSHES = (
    "parts AS (SELECT * FROM (VALUES (0, 7), (7, 40), (40, 400), (400, 9000000000000)) AS t(low, high)),"
    " flushes AS (SELECT low, count(*) AS n FROM messages JOIN parts ON event_id >= low AND event_id < high GROUP BY low)"
)
add(
    "flush_stats",
    "messages",
    f", {_FLUSHES}, batches AS (SELECT n, 'success' AS status FROM flushes UNION ALL SELECT n, 'error' FROM flushes WHERE low = 40),"
    f" siz AS (SELECT * FROM (VALUES {bucket_values('flush_batch_size')}) AS t(le))"
    " SELECT 'flush_total' AS metric, status, CAST(NULL AS DOUBLE) AS le, CAST(count(*) AS DOUBLE) AS value FROM batches GROUP BY status"
    " UNION ALL SELECT CASE status WHEN 'success' THEN 'events_total' ELSE 'buffer_depth' END, status, NULL, CAST(sum(n) AS DOUBLE)"
    " FROM batches GROUP BY status"
    " UNION ALL SELECT 'flush_latency', 'success', CAST('Infinity' AS DOUBLE), CAST(count(*) AS DOUBLE) FROM flushes"
    " UNION ALL SELECT 'flush_batch_size', 'success', le, CAST(count(*) FILTER (WHERE n <= le) AS DOUBLE) FROM siz, flushes GROUP BY le",
)
add(
    "worker_batch_size",
    "messages",
    f", {_FLUSHES}, siz AS (SELECT * FROM (VALUES {bucket_values('worker_batch_size')}) AS t(le))"
    " SELECT le, count(*) FILTER (WHERE n <= le) AS cumulative, count(*) AS total FROM flushes, siz GROUP BY le",
)

# --- streams: the same results, once the windows and timers that stay open at the end are left out ---

add(
    "stream_history_append",
    "task_history",
    "SELECT *, strftime(occurred_at, '%Y-%m') AS event_month FROM task_history",
)
_HISTORY_NOTE = (
    "SELECT 'good' AS part, concat('00000000-0000-4000-8000-', lpad(CAST(user_id AS VARCHAR), 12, '0')) AS key,"
    " CASE WHEN event_id % 10 = 7 THEN 'queued' ELSE 'running' END AS note, count(*) AS n FROM events"
    " WHERE event_id % 10 NOT IN (3, 5) GROUP BY 1, 2, 3 UNION ALL SELECT 'bad', CAST(CAST(floor(event_id / 8) AS BIGINT) AS VARCHAR),"
    " CASE event_id % 10 WHEN 3 THEN 'bad_json' ELSE 'bad_task_id' END, count(*) FROM events"
    " WHERE event_id % 10 IN (3, 5) GROUP BY 1, 2, 3"
)
ORACLES["stream_history_messages"] = _HISTORY_NOTE
add(
    "stream_requests",
    "task_requests",
    f", stored_keys AS (SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS idempotency_key), {_VALID}, {_COMPLETED}"
    " SELECT id, type, max_retries, idempotency_key FROM made",
)
add(
    "stream_unique_keys",
    "task_requests",
    "SELECT idempotency_key, CASE WHEN idempotency_key = '' THEN count(*) ELSE 1 END AS n FROM task_requests GROUP BY 1",
)
add(
    "stream_outbox",
    "messages",
    "SELECT 'sent' AS part, concat('job-', CAST(event_id AS VARCHAR)) AS name FROM messages"
    " WHERE event_id % 3 <> 1 AND event_id % 10 NOT IN (3, 5, 7)"
    " UNION ALL SELECT 'bad', CAST(event_id AS VARCHAR) FROM messages WHERE event_id % 3 <> 1 AND event_id % 10 IN (3, 5, 7)"
    " UNION ALL SELECT 'marked', CAST(event_id AS VARCHAR) FROM messages WHERE event_id % 3 <> 1",
)
add(
    "outbox_log_order",
    "messages",
    ", pending AS (SELECT event_id AS id, event_id % 9 > 0 AS early, row_number() OVER (PARTITION BY event_id % 9 > 0 ORDER BY \"timestamp\", event_id) AS rn"
    " FROM messages WHERE event_id % 3 <> 1) SELECT id, CAST(CASE WHEN early AND rn <= 500 THEN 0 ELSE 1 END AS BIGINT) AS batch_id FROM pending",
)
add(
    "stream_messages",
    "tasks",
    "SELECT CASE WHEN e.event_id % 10 IN (3, 5, 7) THEN 'quarantine' WHEN t.status IN ('succeeded', 'failed', 'dead_lettered')"
    " THEN 'skipped' ELSE 'to_run' END AS part, count(*) AS n FROM events e LEFT JOIN tasks t ON t.id = e.user_id GROUP BY 1",
)
ORACLES["stream_current_state"] = ORACLES["current_state"]
add(
    "stream_rates",
    "samples",
    ", rates AS (SELECT date_trunc('minute', seen_at) AS window_start, kind, count(*) AS events, round(count(*) / 60.0, 9) AS per_second"
    " FROM samples GROUP BY 1, 2) SELECT * FROM rates"
    " WHERE window_start + INTERVAL '1' MINUTE <= (SELECT max(seen_at) - INTERVAL '1' MINUTE FROM samples)",
)
_SLID = (
    "slid AS (SELECT date_trunc('hour', seen_at) - INTERVAL '1' HOUR * k AS window_start, kind, latency_seconds"
    " FROM samples, (VALUES (0), (1), (2), (3), (4)) AS t(k)),"
    f" bounds AS (SELECT CAST(b AS DOUBLE) AS le FROM (VALUES {_BOUNDS}) AS t(b)),"
    " hist AS (SELECT window_start, kind, le, count(*) FILTER (WHERE latency_seconds <= le) AS cumulative, count(*) AS total"
    " FROM slid, bounds GROUP BY 1, 2, 3),"
    " steps AS (SELECT *, coalesce(lag(le) OVER w, 0) AS low, coalesce(lag(cumulative) OVER w, 0) AS bef,"
    " CAST(0.95 AS DOUBLE) * total AS r FROM hist WINDOW w AS (PARTITION BY window_start, kind ORDER BY le)),"
    " first AS (SELECT *, row_number() OVER (PARTITION BY window_start, kind ORDER BY le) AS rn FROM steps WHERE cumulative >= r)"
).replace("('Infinity')", "(CAST('Infinity' AS DOUBLE))")
add(
    "stream_sliding_p95",
    "samples",
    f", {_SLID} SELECT window_start, kind, total, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (r - bef)"
    " / (cumulative - bef) END, 9) AS quantile FROM first WHERE rn = 1"
    " AND window_start + INTERVAL '5' HOUR <= (SELECT max(seen_at) - INTERVAL '1' MINUTE FROM samples)",
)
add(
    "stream_live_totals",
    "samples",
    ", steps AS (SELECT time_bucket(INTERVAL '2 hours', seen_at, TIMESTAMP '1970-01-01 00:00:00') + INTERVAL '2' HOUR AS step_end,"
    " count(*) AS sent, count(*) FILTER (WHERE error <> '') AS err FROM samples GROUP BY 1)"
    " SELECT step_end, sent, sent - err AS ok, err, round((sent - err) / 7200.0, 9) AS current_rate FROM steps"
    " WHERE step_end <= (SELECT max(seen_at) - INTERVAL '10' SECOND FROM samples)",
)
ORACLES["stream_live_totals_default"] = (
    ORACLES["stream_live_totals"].replace("INTERVAL '2 hours'", "INTERVAL '2 seconds'").replace("INTERVAL '2' HOUR", "INTERVAL '2' SECOND").replace("7200.0", "2.0")
)
ORACLES["stream_sliding_p95_default"] = (
    ORACLES["stream_sliding_p95"].replace("date_trunc('hour', seen_at)", "date_trunc('minute', seen_at)").replace("INTERVAL '1' HOUR", "INTERVAL '1' MINUTE")
    .replace("INTERVAL '5' HOUR", "INTERVAL '5' MINUTE")
)
add(
    "stream_end_to_end",
    "samples",
    "SELECT \"index\" AS task_id, seen_at AS created_at, kind AS status, seen_at + INTERVAL '1' MICROSECOND *"
    " CAST(round(latency_seconds * 1000000) AS BIGINT) AS finished_at, round(latency_seconds, 6) AS e2e_seconds"
    " FROM samples WHERE error = '' AND latency_seconds <= 3600 UNION ALL SELECT \"index\", seen_at, NULL, NULL, NULL FROM samples"
    " WHERE (error <> '' OR latency_seconds > 3600) AND seen_at + INTERVAL '1' HOUR < (SELECT least(max(seen_at), max(CASE WHEN error = ''"
    " THEN seen_at + INTERVAL '1' MICROSECOND * CAST(round(latency_seconds * 1000000) AS BIGINT) END)) - INTERVAL '10' MINUTE FROM samples)",
)
add(
    "stream_reaper",
    "task_history",
    ", newest AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY occurred_at DESC, id DESC) AS rn FROM task_history),"
    " due AS (SELECT task_id, CAST(task_id % 5 AS INT) AS retries, occurred_at + INTERVAL '1' SECOND * CAST(30 * (1 + task_id % 4) AS INT)"
    " AS due_at FROM newest WHERE rn = 1 AND status = 'running')"
    " SELECT CAST(task_id AS VARCHAR) AS task_id, CASE WHEN retries < 3 THEN 'requeued' ELSE 'dead_lettered' END AS outcome,"
    " CASE WHEN retries < 3 THEN retries + 1 ELSE retries END AS retry_count,"
    f" CASE WHEN retries >= 3 THEN '{S.REAPED_MESSAGE}' END AS error_message, due_at FROM due"
    " WHERE due_at < (SELECT max(occurred_at) - INTERVAL '30' SECOND FROM task_history)",
)
_PARTS = "parts AS (SELECT * FROM (VALUES (10), (20), (32)) AS t(until))"
add(
    "stream_reaper_late",
    "task_history",
    f", {_PARTS}, arrived AS (SELECT *, occurred_at + INTERVAL '1' SECOND * CAST(id * 37 % 600 AS INT) AS arrived_at FROM task_history),"
    " known AS (SELECT p.until, a.*, row_number() OVER (PARTITION BY p.until, task_id ORDER BY occurred_at DESC, id DESC) AS rn"
    " FROM parts p JOIN arrived a ON day(a.arrived_at) < p.until),"
    " marks AS (SELECT p.until, max(arrived_at) - INTERVAL '1' SECOND AS mark FROM parts p JOIN arrived a ON day(a.arrived_at) < p.until GROUP BY 1),"
    " due AS (SELECT until, task_id, CAST(task_id % 5 AS INT) AS retries, occurred_at + INTERVAL '1' SECOND * CAST(30 * (1 + task_id % 4) AS INT)"
    " AS due_at FROM known WHERE rn = 1 AND status = 'running')"
    " SELECT DISTINCT CAST(task_id AS VARCHAR) AS task_id, CASE WHEN retries < 3 THEN 'requeued' ELSE 'dead_lettered' END AS outcome,"
    " CASE WHEN retries < 3 THEN retries + 1 ELSE retries END AS retry_count,"
    f" CASE WHEN retries >= 3 THEN '{S.REAPED_MESSAGE}' END AS error_message, due_at FROM due JOIN marks USING (until)"
    " WHERE due_at + INTERVAL '600' SECOND < mark",
)
add(
    "stream_due_retries_late",
    "samples",
    ", due AS (SELECT \"index\" AS task_id, CAST(\"index\" % 5 AS INT) + 1 AS retry_count, seen_at + INTERVAL '1' SECOND *"
    " CAST(least(5 * power(2, \"index\" % 5), 300) AS INT) AS run_after, seen_at + INTERVAL '1' SECOND * CAST(\"index\" * 37 % 600 AS INT) AS arrived_at"
    " FROM samples WHERE error <> '' AND \"index\" % 5 < 4)"
    " SELECT CAST(task_id AS VARCHAR) AS task_id, retry_count, run_after FROM due"
    " WHERE run_after <= (SELECT max(arrived_at) - INTERVAL '1' SECOND FROM due)",
)
add(
    "stream_due_retries",
    "samples",
    ", due AS (SELECT \"index\" AS task_id, CAST(\"index\" % 5 AS INT) + 1 AS retry_count, seen_at + INTERVAL '1' SECOND *"
    " CAST(least(5 * power(2, \"index\" % 5), 300) AS INT) AS run_after FROM samples WHERE error <> '' AND \"index\" % 5 < 4)"
    " SELECT CAST(task_id AS VARCHAR) AS task_id, retry_count, run_after FROM due"
    " WHERE run_after <= (SELECT max(seen_at) - INTERVAL '10' SECOND FROM samples WHERE error <> '' AND \"index\" % 5 < 4)",
)
add(
    "stream_dlq",
    "tasks",
    f", routed AS (SELECT *, {_OUTCOME} AS outcome FROM tasks WHERE status = 'running')"
    f" SELECT 'retry' AS part, id, {T} + INTERVAL '1' SECOND * {_BACKOFF} AS run_after, CAST(NULL AS VARCHAR) AS error FROM routed"
    " WHERE outcome = 'retry' UNION ALL SELECT 'dead', id, NULL, concat('boom ', CAST(id AS VARCHAR)) FROM routed"
    " WHERE outcome = 'dead_lettered'",
)
_FAILED = "failed AS (SELECT *, CASE WHEN retry_count < max_retries THEN 'retry' ELSE 'dead' END AS part FROM tasks WHERE status = 'running')"
add(
    "stream_dlq_ahead",
    "tasks",
    f", {_FAILED} SELECT part, id FROM failed UNION ALL SELECT 'unmatched', id + 5000000000 FROM failed WHERE id % 5 = 0",
)
add("stream_retention", "task_history", f"SELECT * FROM task_history WHERE occurred_at >= {E} - INTERVAL '86400' SECOND")
_TEXT_LOG = "SELECT CAST(id AS VARCHAR) AS id, CAST(task_id AS VARCHAR) AS task_id, status, occurred_at"
add(
    "history_repartitioned",
    "task_history",
    f"{_TEXT_LOG}, 'range' AS part FROM task_history WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00'"
    f" AND occurred_at < TIMESTAMP '2024-01-08 00:00:00' UNION ALL {_TEXT_LOG}, 'back' FROM task_history",
)
add(
    "dlq_table_roundtrip",
    "dead_letters",
    "SELECT CAST(id AS VARCHAR) AS id, CAST(original_task_id AS VARCHAR) AS original_task_id, error_message, retry_count,"
    " json_extract_string(payload, '$.cust') AS payload_cust, dead_lettered_at FROM dead_letters",
)
add(
    "outbox_table_roundtrip",
    "tasks",
    "SELECT CAST(id AS VARCHAR) AS task_id, type, priority, json_extract_string(payload, '$.cust') AS payload_cust, true AS pending"
    " FROM tasks WHERE status = 'queued'",
)
add(
    "route_deltas",
    "tasks",
    f", routed AS (SELECT *, {_OUTCOME} AS outcome FROM tasks WHERE status = 'running' AND id % 7 <> 0)"
    " SELECT 'log' AS part, id, CASE outcome WHEN 'retry' THEN 'queued' ELSE outcome END AS body FROM routed"
    " UNION ALL SELECT 'dead', id, concat('boom ', CAST(id AS VARCHAR)) FROM routed WHERE outcome = 'dead_lettered'"
    " UNION ALL SELECT 'again', id, NULL FROM routed WHERE outcome = 'retry'"
    " UNION ALL SELECT 'missing', id + 5000000000, NULL FROM tasks WHERE status = 'running' AND id % 7 = 0",
)
add(
    "retention_drop",
    "task_history",
    ", spread AS (SELECT id, task_id, status, occurred_at + INTERVAL '30' DAY * (CAST(id % 4 AS INT) - 2) AS occurred_at FROM task_history)"
    " SELECT CAST(id AS VARCHAR) AS id, CAST(task_id AS VARCHAR) AS task_id, status, occurred_at, strftime(occurred_at, '%Y-%m') AS event_month"
    " FROM spread WHERE occurred_at >= TIMESTAMP '2024-01-10 12:00:00'",
)
add(
    "key_store_rounds",
    "task_requests",
    "SELECT idempotency_key, id FROM (SELECT idempotency_key, id, row_number() OVER (PARTITION BY idempotency_key ORDER BY id % 5, id) AS rn"
    " FROM task_requests WHERE idempotency_key <> '') WHERE rn = 1",
)
add(
    "task_store_rounds",
    "tasks",
    "SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 6 = 0 THEN 'round 4' WHEN id % 5 = 0 THEN 'round 3' WHEN id % 4 = 0 THEN 'round 2'"
    " WHEN id % 3 = 0 THEN 'round 1' ELSE status END AS status, CAST((id % 3 = 0)::INT + (id % 4 = 0)::INT + (id % 5 = 0)::INT + (id % 6 = 0)::INT"
    " AS BIGINT) AS seq, json_extract_string(payload, '$.cust') AS payload_cust FROM tasks",
)
add(
    "history_layout_roundtrip",
    "task_history",
    "SELECT CAST(id AS VARCHAR) AS id, CAST(task_id AS VARCHAR) AS task_id, status, occurred_at FROM task_history"
    " WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00' AND occurred_at < TIMESTAMP '2024-01-25 00:00:00'",
)
add(
    "task_table_roundtrip",
    "tasks",
    f", {_STALE} SELECT CAST(id AS VARCHAR) AS id, CASE outcome WHEN 'requeued' THEN 'queued' ELSE 'dead_lettered' END AS status,"
    " CASE outcome WHEN 'requeued' THEN retry_count + 1 ELSE retry_count END AS retry_count, outcome FROM stale",
)


def _report_part(section: str, source: str, measures: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{name}' AS measure, round(CAST({expr} AS DOUBLE), 6) AS value FROM {source}"
        for name, expr in measures
    )


def _ranked(name: str, source: str, value: str, where: str) -> str:
    ranked = f"SELECT {value} AS v, row_number() OVER (ORDER BY {value}) AS rn, count(*) OVER () AS n FROM {source} WHERE {where}"
    picks = ", ".join(
        f"floor(max(CASE WHEN rn = greatest(ceil(n * {p} / 100), 1) THEN v END) * 1000 + 0.000001) / 1000 AS {label}"
        for p, label in (("50.0", "p50"), ("95.0", "p95"), ("99.0", "p99"), ("CAST(99.9 AS DOUBLE)", "p999"))
    )
    return f"{name} AS (SELECT {picks} FROM ({ranked}))"


_SHARES = [(p, p) for p in ("p50", "p95", "p99", "p999")]
_DONE = "status IN ('succeeded', 'dead_lettered')"
add(
    "load_report",
    "samples task_history",
    ", fin AS (SELECT h.status, s.latency_seconds AS e2e, h.occurred_at FROM task_history h JOIN samples s ON s.\"index\" = h.id),"
    f" {_ranked('cl', 'samples', 'latency_seconds', "error = ''")},"
    f" {_ranked('fl', 'fin', 'e2e', _DONE)},"
    f" ok AS (SELECT count(*) / ({seconds('min(seen_at)', 'max(seen_at)')}) AS r FROM samples WHERE error = ''),"
    f" dn AS (SELECT count(*) / ({seconds('min(occurred_at)', 'max(occurred_at)')}) AS r FROM fin WHERE {_DONE}) "
    + " UNION ALL ".join(
        [
            _report_part(
                "create",
                "samples",
                [
                    ("created", "count(*) FILTER (WHERE error = '')"),
                    ("errors", "count(*) FILTER (WHERE error <> '')"),
                    ("error_rate", "100.0 * count(*) FILTER (WHERE error <> '') / count(*)"),
                ],
            ),
            _report_part("create_latency", "cl", _SHARES),
            _report_part("create_rate", "ok", [("per_second", "r")]),
            _report_part(
                "finish",
                "fin",
                [
                    ("completed", "count(*) FILTER (WHERE status = 'succeeded')"),
                    ("failed", "count(*) FILTER (WHERE status IN ('failed', 'dead_lettered'))"),
                    ("stuck", "count(*) FILTER (WHERE status IN ('queued', 'running'))"),
                ],
            ),
            _report_part("finish_latency", "fl", _SHARES),
            _report_part("finish_rate", "dn", [("per_second", "r")]),
        ]
    ),
)
