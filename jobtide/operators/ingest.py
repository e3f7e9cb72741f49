"""From request rows to task rows: defaults, validation, idempotency, creation."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.scalars import blank_to_null, instant, null_to_blank, quoted, seq_of, surrogate_id
from jobtide.operators.skew import lookup_by_key, settled
from jobtide.sources.tables import outbox_rows


def apply_request_defaults(req: DataFrame, as_of: str | datetime | Column, ts_type: str = "timestamp") -> DataFrame:
    """Request columns completed to task columns. Zero counts as "not given" for retries and timeout."""
    at = (as_of if isinstance(as_of, Column) else F.lit(str(as_of))).cast(ts_type)

    def given(name: str, default: int) -> Column:
        value = F.coalesce(F.col(name), F.lit(0))
        return F.when(value == 0, F.lit(default)).otherwise(value).cast("int")

    return req.withColumns(
        {
            "priority": F.coalesce(F.col("priority"), F.lit(0)).cast("int"),
            "max_retries": given("max_retries", S.DEFAULT_MAX_RETRIES),
            "timeout_seconds": given("timeout_seconds", S.DEFAULT_TIMEOUT_SECONDS),
            "idempotency_key": blank_to_null("idempotency_key"),
            "status": F.lit(S.QUEUED),
            "retry_count": F.lit(0),
            "created_at": at,
            "updated_at": at,
            "run_after": at,
            "seq": F.lit(1).cast("bigint"),
        }
    )


def _with_known_flag(req: DataFrame, known_types: Iterable[str] | DataFrame) -> DataFrame:
    if isinstance(known_types, DataFrame):
        registry = known_types.select(F.col("type")).distinct().withColumn("type_known", F.lit(True))
        joined = req.join(registry, "type", "left")
        return joined.withColumn("type_known", F.coalesce("type_known", F.lit(False)))
    return req.withColumn("type_known", F.coalesce(F.col("type").isin(*known_types), F.lit(False)))


def known_types(req: DataFrame, registry: Iterable[str] | DataFrame, known: bool = True) -> DataFrame:
    """Requests whose type is (or is not) registered."""
    flagged = _with_known_flag(req, registry)
    return flagged.where(F.col("type_known") if known else ~F.col("type_known")).drop("type_known")


def validate_requests(req: DataFrame, known_types: Iterable[str] | DataFrame = S.BUILTIN_TYPES) -> DataFrame:
    """Adds ``code`` and ``message`` of the first rule a request breaks; ``OK`` and NULL when none."""
    parsed = F.coalesce(F.col("json_ok"), F.lit(False)) if "json_ok" in req.columns else F.lit(True)
    flagged = _with_known_flag(req, known_types)
    code = (
        F.when(~parsed, S.INVALID_JSON_BODY)
        .when(null_to_blank("name") == "", S.NAME_REQUIRED)
        .when(null_to_blank("type") == "", S.TYPE_REQUIRED)
        .when(~F.col("type_known"), S.UNKNOWN_TASK_TYPE)
        .when(F.col("payload").isNull(), S.PAYLOAD_NULL)
        .otherwise(S.OK)
    )
    message = F.when(
        F.col("code") == S.UNKNOWN_TASK_TYPE, F.concat(F.lit("unknown task type "), quoted("type"))
    )
    for name in (S.INVALID_JSON_BODY, S.NAME_REQUIRED, S.TYPE_REQUIRED, S.PAYLOAD_NULL):
        message = message.when(F.col("code") == name, S.MESSAGES[name])
    return flagged.withColumn("code", code).withColumn("message", message).drop("type_known")


def validate_batches(
    req: DataFrame,
    batch_id: str = "batch_id",
    idx: str = "idx",
    known_types: Iterable[str] | DataFrame = S.BUILTIN_TYPES,
) -> DataFrame:
    """One row per batch: ``size, code, bad_idx, message``. A batch passes or fails as a whole.

    A row with ``idx`` NULL stands for an empty batch. Only one struct per batch leaves each map
    task, however many rows the batch has.
    """
    checked = validate_requests(req, known_types)
    broken = F.col("code") == S.INVALID_JSON_BODY
    bad = F.when(F.col("code").isin(S.OK, S.INVALID_JSON_BODY) | F.col(idx).isNull(), None)
    first_bad = bad.otherwise(F.struct(F.col(idx).alias("idx"), F.col("code").alias("code"), F.col("message").alias("message")))
    grouped = checked.groupBy(batch_id).agg(
        F.count(idx).alias("size"), F.max(broken).alias("broken"), F.min(first_bad).alias("first_bad")
    )
    code = (
        F.when(F.col("broken"), S.INVALID_JSON_BODY)
        .when(F.col("size") == 0, S.EMPTY_BATCH)
        .when(F.col("size") > S.MAX_BATCH_REQUESTS, S.BATCH_TOO_LARGE)
        .when(F.col("first_bad").isNotNull(), F.col("first_bad.code"))
        .otherwise(S.OK)
    )
    by_element = ~F.col("code").isin(S.OK, S.INVALID_JSON_BODY, S.EMPTY_BATCH, S.BATCH_TOO_LARGE)
    prefix = F.concat(F.lit("task["), F.col("first_bad.idx").cast("string"), F.lit("]: "))
    message = F.when(by_element, F.concat(prefix, F.col("first_bad.message")))
    for name in (S.INVALID_JSON_BODY, S.EMPTY_BATCH, S.BATCH_TOO_LARGE):
        message = message.when(F.col("code") == name, S.MESSAGES[name])
    return (
        grouped.withColumn("code", code)
        .withColumn("message", message)
        .select(batch_id, "size", "code", F.when(by_element, F.col("first_bad.idx")).alias("bad_idx"), "message")
    )


def first_by_key(req: DataFrame, key: str, order: list[str], id: str = "id") -> DataFrame:
    """``(key, first_id, n)``: the first row of every non-null key and how many rows share it.
    One struct per key leaves each map task, however many rows a key has."""
    ranked = F.struct(*[F.col(c) for c in dict.fromkeys([*order, id])])
    keyed = req.where(F.col(key).isNotNull())
    return keyed.groupBy(key).agg(F.min(ranked)[id].alias("first_id"), F.count("*").alias("n"))


def resolve_idempotency(
    req: DataFrame,
    tasks: DataFrame | None,
    order: list[str],
    id: str = "id",
    key: str = "idempotency_key",
    prune_stored: bool = False,
) -> DataFrame:
    """Adds ``task_id`` (the row that owns the key) and ``outcome`` (``CREATED`` or ``EXISTING``).

    A key known to ``tasks`` keeps its stored row; otherwise the first request with the key owns it.
    Rows without a key own themselves. With ``prune_stored``, for a few requests against many stored keys,
    stored rows whose key is not asked for leave before the join; Spark decides how by the sizes it meets.
    """
    id_type = req.schema[id].dataType
    owners = first_by_key(req, key, order, id)
    if tasks is not None:
        stored = tasks.where(F.col(key).isNotNull()).select(key, F.col("id").cast(id_type).alias("stored_id"))
        if prune_stored:
            stored = stored.join(owners.select(key), key, "left_semi")
        owners = owners.join(stored, key, "left")
    else:
        owners = owners.withColumn("stored_id", F.lit(None).cast(id_type))
    # Settled, as the lookup reads it twice: once for its heaviest keys.
    found = lookup_by_key(req, settled(owners.select(key, "first_id", "stored_id", "n")), key, spread_by=id)
    owner = F.coalesce("stored_id", "first_id", id)
    fresh = F.col("stored_id").isNull() & (owner == F.col(id))
    return found.select(
        *req.columns, owner.alias("task_id"), F.when(fresh, "CREATED").otherwise("EXISTING").alias("outcome")
    )


@dataclass(frozen=True)
class CreateResult:
    """``outcomes`` has a row for every request; the other three hold what is to be stored."""

    outcomes: DataFrame
    tasks: DataFrame
    history: DataFrame
    outbox: DataFrame


def history_rows(tasks: DataFrame, status: str | Column, at: Column, id: str = "id") -> DataFrame:
    """Log rows of ``tasks`` as they are after a state change: their ``seq`` tells rows of one instant apart."""
    state = F.lit(status) if isinstance(status, str) else status
    seq = seq_of(tasks)
    return tasks.select(
        surrogate_id(id, state, at, seq).alias("id"),
        F.col(id).alias("task_id"),
        state.alias("status"),
        at.alias("occurred_at"),
        seq.alias("seq"),
    )


def create_tasks(
    req: DataFrame,
    as_of: str | datetime | Column,
    tasks: DataFrame | None = None,
    known_types: Iterable[str] | DataFrame = S.BUILTIN_TYPES,
    order: list[str] | None = None,
    ts_type: str = "timestamp",
    prune_stored: bool = False,
) -> CreateResult:
    """Validate, complete, de-duplicate. ``req`` carries a unique ``id`` for each request, which becomes
    the task id; ``order`` says which of two requests with one key came first (default: by id)."""
    checked = validate_requests(req, known_types)
    refused = checked.where(F.col("code") != S.OK).select(
        "id", "code", "message", F.lit(None).cast(req.schema["id"].dataType).alias("task_id"), F.lit("REJECTED").alias("outcome")
    )
    made = _create_valid(checked.where(F.col("code") == S.OK), as_of, tasks, order or ["id"], ts_type, prune_stored)
    return replace(made, outcomes=made.outcomes.unionByName(refused))


def _create_valid(
    valid: DataFrame, as_of: str | datetime | Column, tasks: DataFrame | None, order: list[str], ts_type: str, prune_stored: bool = False
) -> CreateResult:
    ready = apply_request_defaults(valid, as_of, ts_type)
    resolved = resolve_idempotency(ready, tasks, order, prune_stored=prune_stored)
    outcomes = resolved.select("id", "code", "message", "task_id", "outcome")
    new = resolved.where(F.col("outcome") == "CREATED").select(*S.TASK_COLUMNS, "seq")
    at = instant(new, "created_at", as_of)
    return CreateResult(outcomes, new, history_rows(new, S.QUEUED, at), outbox_rows(new, as_of))


def create_task_batches(
    req: DataFrame,
    as_of: str | datetime | Column,
    tasks: DataFrame | None = None,
    known_types: Iterable[str] | DataFrame = S.BUILTIN_TYPES,
    strict: bool = False,
    ts_type: str = "timestamp",
) -> tuple[DataFrame, CreateResult]:
    """``(batches, result)``: batches that pass are created row by row, in input order.

    A duplicate key inside a batch yields the existing row. With ``strict``, a batch that holds a key
    twice or a key already stored is refused as a whole with ``DUPLICATE_KEY``.
    """
    batches = validate_batches(req, known_types=known_types)
    if strict:
        keyed = req.select("batch_id", "idx", blank_to_null("idempotency_key").alias("idempotency_key"))
        keyed = keyed.where(F.col("idempotency_key").isNotNull())
        per_key = keyed.groupBy("batch_id", "idempotency_key").agg(F.count("*").alias("n"))
        clash = per_key.where("n > 1").select("batch_id")
        if tasks is not None:
            taken = tasks.where(F.col("idempotency_key").isNotNull()).select("idempotency_key")
            clash = clash.unionByName(per_key.join(taken, "idempotency_key", "left_semi").select("batch_id"))
        clash = clash.distinct().withColumn("clash", F.lit(True))
        refused = F.col("clash").isNotNull() & (F.col("code") == S.OK)
        batches = (
            batches.join(clash, "batch_id", "left")
            .withColumn("code", F.when(refused, "DUPLICATE_KEY").otherwise(F.col("code")))
            .drop("clash")
        )
    verdict = batches.select("batch_id", F.col("code").alias("batch_code"), F.col("size").alias("n"))
    tagged = lookup_by_key(req.where(F.col("idx").isNotNull()), verdict, "batch_id", spread_by="id")
    # Every row of a batch that passed is valid; there is nothing to check again.
    accepted = tagged.where(F.col("batch_code") == S.OK).withColumnRenamed("batch_code", "code")
    accepted = accepted.withColumn("message", F.lit(None).cast("string"))
    return batches, _create_valid(accepted, as_of, tasks, ["batch_id", "idx"], ts_type)
