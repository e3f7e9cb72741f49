"""Task requests from JSON text: one object per line, or an array of objects per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.jsontext import NUMBER_FIELDS, is_object, open_documents


def _request_columns(df: DataFrame, text: str, strict: bool) -> DataFrame:
    """Request fields beside the input columns, ``json_ok`` false where the text does not decode."""
    opened, doc = open_documents(df, text, whole=False)
    return opened.select(
        *df.columns,
        (doc.fits() if strict else is_object(text)).alias("json_ok"),
        doc.blank_text("name").alias("name"),
        doc.blank_text("type").alias("type"),
        doc.payload().alias("payload"),
        *[doc.number(f).alias(f) for f in NUMBER_FIELDS],
        doc.blank_text("idempotency_key").alias("idempotency_key"),
    )


def parse_requests(df: DataFrame, text: str = "value", strict: bool = True) -> DataFrame:
    return _request_columns(df, text, strict).drop(text)


def parse_request_batches(df: DataFrame, batch_id: str, text: str = "value", strict: bool = True) -> DataFrame:
    """One row per array element with its position ``idx``; every batch keeps at least one row.

    An empty array gives one row with ``idx`` NULL. Text that is no array, or an element that does not
    decode, makes ``json_ok`` false for that row (and the batch is refused as a whole later on).
    """
    elements = F.from_json(text, "array<string>")
    is_array = F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY"), F.lit(False))
    others = [c for c in df.columns if c not in (text, batch_id)]
    rows = df.select(
        batch_id,
        *others,
        is_array.alias("is_array"),
        F.posexplode_outer(F.when(is_array, elements)).alias("idx", "element"),
    )
    fields = _request_columns(rows, "element", strict)
    decoded = F.when(F.col("idx").isNull(), F.col("is_array")).otherwise(F.col("is_array") & F.col("json_ok"))
    return fields.withColumn("json_ok", decoded).drop("element", "is_array")


def read_requests(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_requests(spark.read.text(path), "value", strict)


def read_request_batches(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Batch id: digest of the text and the file it stands in."""
    lines = spark.read.text(path).withColumn(
        "batch_id", F.md5(F.concat_ws(":", F.col("_metadata.file_path"), F.col("value")))
    )
    return parse_request_batches(lines, "batch_id", "value", strict)
