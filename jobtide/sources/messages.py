"""Topic messages in Spark's message-source row shape: build, parse, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import schemas as S
from jobtide.functions.headers import build_headers
from jobtide.functions.jsontext import NUMBER_FIELDS, TEXT_FIELDS, open_documents
from jobtide.functions.scalars import blank_to_null, canonical_uuid, parse_rfc3339, rfc3339, surrogate_id


def _task_body() -> Column:
    """Wire JSON. Fields that are NULL are left out, which is how an empty key disappears."""
    return F.to_json(
        F.struct(
            F.col("id").cast("string").alias("task_id"),
            "name",
            "type",
            F.coalesce("payload", F.create_map().cast(S.PAYLOAD)).alias("payload"),
            "priority",
            "max_retries",
            "timeout_seconds",
            "retry_count",
            blank_to_null("idempotency_key").alias("idempotency_key"),
        )
    )


def to_task_messages(tasks: DataFrame, topic: str = "tasks") -> DataFrame:
    return tasks.select(
        F.col("type").cast("binary").alias("key"),
        _task_body().cast("binary").alias("value"),
        build_headers(task_id=F.col("id"), retry_count=F.col("retry_count")).alias("headers"),
        F.lit(topic).alias("topic"),
    )


def to_dlq_messages(tasks: DataFrame, error: str | Column, topic: str | None = "tasks-dlq") -> DataFrame:
    """Dead-letter form; without a topic there is nothing to send."""
    text = F.col(error) if isinstance(error, str) else error
    rows = tasks.select(
        F.col("type").cast("binary").alias("key"),
        _task_body().cast("binary").alias("value"),
        build_headers(task_id=F.col("id"), error=text).alias("headers"),
        F.lit(topic).cast("string").alias("topic"),
    )
    return rows if topic else rows.where(F.lit(False))


def to_history_messages(history: DataFrame, topic: str = "task-history") -> DataFrame:
    seq = [F.col("seq").cast("bigint").alias("seq")] if "seq" in history.columns else []
    body = F.struct(F.col("task_id").cast("string").alias("task_id"), "status", rfc3339(history, "occurred_at").alias("at"), *seq)
    return history.select(
        F.col("task_id").cast("string").cast("binary").alias("key"),
        F.to_json(body).cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
    )


def _meta() -> Column:
    return F.create_map(
        F.lit("partition"),
        F.col("partition").cast("string"),
        F.lit("offset"),
        F.col("offset").cast("string"),
        F.lit("topic"),
        F.col("topic"),
    )


_COUNTS = (*NUMBER_FIELDS, "retry_count")


def _spread(messages: DataFrame) -> DataFrame:
    """``messages`` dealt over the cluster by their place in their topic: decoding takes far longer than reading, and a source
    of few files or partitions would leave it to as few tasks."""
    return messages.repartition("topic", "partition", "offset")


def read_task_messages(messages: DataFrame) -> DataFrame:
    """Every message decoded, ``reject_reason`` NULL for the good ones."""
    texts = ("task_id", *TEXT_FIELDS)
    opened, doc = open_documents(_spread(messages), "value", texts, _COUNTS)
    task_id = canonical_uuid(doc.text("task_id"))
    return opened.select(
        *messages.columns,
        F.when(~doc.fits(), "bad_json").when(task_id.isNull(), "bad_task_id").alias("reject_reason"),
        task_id.alias("task_id"),
        doc.blank_text("name").alias("name"),
        doc.blank_text("type").alias("type"),
        doc.payload().alias("payload"),
        *[doc.number(f).alias(f) for f in _COUNTS],
        doc.blank_text("idempotency_key").alias("idempotency_key"),
        _meta().alias("meta"),
    )


def read_outbox_payloads(outbox: DataFrame) -> DataFrame:
    """Outbox rows with the fields of their payload; ``good`` is false where it does not decode."""
    texts = ("task_id", *TEXT_FIELDS)
    opened, doc = open_documents(outbox, "payload", texts)
    task_id = canonical_uuid(doc.text("task_id"))
    kept = [c for c in outbox.columns if c not in ("payload", "task_id")]
    return opened.select(
        *kept,
        F.col("payload").alias("raw_payload"),
        F.col("task_id").alias("raw_task_id"),
        (doc.fits() & task_id.isNotNull()).alias("good"),
        task_id.alias("task_id"),
        *[doc.blank_text(f).alias(f) for f in TEXT_FIELDS],
        *[doc.number(f).alias(f) for f in NUMBER_FIELDS],
        doc.payload().alias("payload"),
    )


def _quarantined(decoded: DataFrame) -> DataFrame:
    keep = [c for c in S.MESSAGE_ROW.fieldNames() if c in decoded.columns]
    return decoded.where("reject_reason IS NOT NULL").select(*keep, "reject_reason")


def parse_task_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(good, bad)``: tasks to run, and untouched rows for the quarantine. Bad ones count as consumed."""
    return split_task_messages(read_task_messages(messages))


def split_task_messages(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_task_messages`` of rows that are decoded already."""
    good = decoded.where("reject_reason IS NULL").select(
        "task_id",
        "name",
        "type",
        "payload",
        "priority",
        "max_retries",
        "timeout_seconds",
        "retry_count",
        "idempotency_key",
        "meta",
    )
    return good, _quarantined(decoded)


def read_history_messages(messages: DataFrame) -> DataFrame:
    """Every event decoded. A time that does not parse is replaced by the record's own time, not by
    the clock, so a replay gives the same rows."""
    opened, doc = open_documents(_spread(messages), "value", ("task_id", "status", "at"), ("seq",), payload=False)
    task_id = canonical_uuid(doc.text("task_id"))
    status = doc.blank_text("status")
    at = F.coalesce(parse_rfc3339(doc.text("at")), F.col("timestamp").cast("timestamp"))
    seq = doc.whole_number("seq")
    return opened.select(
        *messages.columns,
        F.when(~doc.fits(), "bad_json").when(task_id.isNull(), "bad_task_id").alias("reject_reason"),
        surrogate_id(task_id, status, at, seq).alias("id"),
        task_id.alias("task_id"),
        status.alias("status"),
        at.alias("occurred_at"),
        seq.alias("seq"),
    )


def parse_history_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_history_messages(read_history_messages(messages))


def split_history_messages(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parse_history_messages`` of rows that are decoded already."""
    good = decoded.where("reject_reason IS NULL").select(*S.LOG_COLUMNS)
    return good, _quarantined(decoded)


def write_messages(messages: DataFrame, target: str, options: dict[str, str] | None = None) -> None:
    """To a broker when connection options are given (its Spark connector must be present), else to files."""
    if options:
        messages.write.format("kafka").options(**options).save()
    else:
        messages.write.mode("append").parquet(target)
