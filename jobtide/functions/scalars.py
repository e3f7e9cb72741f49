"""Column expressions: time, retry rules, identifiers and status tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide import schemas as S

RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
HEX_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(df: DataFrame, column: str, as_of: str | datetime | Column) -> Column:
    """``as_of`` in the timestamp type of ``df[column]``, so zoned and zoneless tables keep their type."""
    if isinstance(as_of, Column):
        return as_of.cast(df.schema[column].dataType)
    return F.lit(str(as_of)).cast(df.schema[column].dataType)


def micros(ts: str | Column) -> Column:
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def plus_seconds(ts: str | Column, seconds: str | Column) -> Column:
    return col(ts) + F.make_dt_interval(secs=col(seconds).cast("decimal(18,6)"))


def seq_of(df: DataFrame) -> Column:
    """How many state changes a task row has had, or the ordinal of a log row; 0 where that is not kept."""
    return F.coalesce(F.col("seq"), F.lit(0)).cast("bigint") if "seq" in df.columns else F.lit(0).cast("bigint")


def backoff_seconds(retry_count: str | Column) -> Column:
    """Delay before the next attempt, from the count before it is raised."""
    grown = F.lit(float(S.BACKOFF_BASE_SECONDS)) * F.pow(F.lit(2.0), col(retry_count))
    return F.least(grown, F.lit(float(S.BACKOFF_CAP_SECONDS))).cast("int")


def deadline(updated_at: str | Column = "updated_at", timeout: str | Column = "timeout_seconds") -> Column:
    return plus_seconds(updated_at, timeout)


def is_terminal(status: str | Column = "status") -> Column:
    return F.coalesce(col(status).isin(*S.TERMINAL_STATUSES), F.lit(False))


def can_retry(retry_count: str | Column = "retry_count", max_retries: str | Column = "max_retries") -> Column:
    return col(retry_count) < col(max_retries)


def _utc_day(ts: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def utc_text(ts: Column) -> Column:
    """A zoned time as its UTC text, whatever the session's zone: ``2024-01-15 10:00:00.5``."""
    inside = F.pmod(F.unix_micros(ts), F.lit(86_400_000_000))
    part = lambda size, of: F.lpad((F.floor(inside / F.lit(size)) % of).cast("string"), 2, "0")
    clock = F.concat_ws(":", part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60))
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad((inside % 1_000_000).cast("string"), 6, "0")), r"\.?0+$", "")
    return F.concat(_utc_day(ts).cast("string"), F.lit(" "), clock, fraction)


def event_month(ts: str | Column) -> Column:
    """Month of a time; of a zoned one the UTC month, so that a reader in another zone finds what was written."""
    c = col(ts)
    zoned = F.date_format(_utc_day(c.cast("timestamp")), "yyyy-MM")
    return F.when(F.typeof(c) == "timestamp", zoned).otherwise(F.date_format(c, "yyyy-MM"))


def hex_to_uuid(digits: Column) -> Column:
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def surrogate_id(*natural_key: str | Column) -> Column:
    """Identifier that is the same on every run, every task retry and in every session zone: a digest of
    the natural key."""

    def text(c: Column) -> Column:
        return F.when(F.typeof(c) == "timestamp", utc_text(c.try_cast("timestamp"))).otherwise(c.cast("string"))

    return hex_to_uuid(F.md5(F.concat_ws(":", *[text(col(c)) for c in natural_key])))


def canonical_uuid(text: str | Column) -> Column:
    """Lower-case 8-4-4-4-12 form of any accepted spelling, NULL for anything else.

    Accepted: the plain form, the same with one enclosing character on each side, with a
    ``urn:uuid:`` prefix, and 32 bare hex digits.
    """
    raw = col(text)
    return (
        F.when(raw.rlike(f"^{HEX_UUID}$"), F.lower(raw))
        .when(raw.rlike("^[0-9a-fA-F]{32}$"), F.lower(hex_to_uuid(raw)))
        .when(raw.rlike(f"^(?i:urn:uuid:){HEX_UUID}$"), F.lower(F.substring(raw, 10, 36)))
        .when(raw.rlike(f"^.{HEX_UUID}.$"), F.lower(F.substring(raw, 2, 36)))
    )


def check_task_id(text: str | Column, error_code: str = S.INVALID_TASK_ID) -> Column:
    """NULL for an id that parses, the error code for one that does not."""
    return F.when(canonical_uuid(text).isNull(), F.lit(error_code))


def blank_to_null(text: str | Column) -> Column:
    return F.nullif(col(text), F.lit(""))


def null_to_blank(text: str | Column) -> Column:
    return F.coalesce(col(text), F.lit(""))


def rfc3339(df: DataFrame, ts: str) -> Column:
    """UTC text with trailing zeros of the fraction cut, e.g. ``2024-01-15T10:00:00.5Z``."""
    value = F.col(ts)
    if df.schema[ts].dataType.typeName() == "timestamp":
        value = F.to_utc_timestamp(value, F.current_timezone())
    return F.concat(F.replace(value.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def parse_rfc3339(text: str | Column) -> Column:
    """The time, or NULL unless the text has date, ``T``, time and a zone; nothing is filled in from the clock."""
    return F.when(col(text).rlike(RFC3339), F.try_to_timestamp(col(text)))


def truncate_ms(seconds: str | Column) -> Column:
    """Cut to whole milliseconds; the small nudge keeps 0.29 s at 290 ms despite binary rounding."""
    return F.floor(col(seconds) * 1000.0 + 1e-6) / F.lit(1000.0)


def truncate_seconds(seconds: str | Column) -> Column:
    return F.floor(col(seconds)).cast("bigint")


def route_pattern(path: str | Column) -> Column:
    """Ids inside a path collapsed to ``{id}``, so that routes can be counted."""
    return F.regexp_replace(col(path), f"/(?:{HEX_UUID})(?=/|$)", "/{id}")


def severity(status: str | Column) -> Column:
    code = col(status)
    return F.when(code >= 500, "error").when(code >= 400, "warn").otherwise("info")


#: Control characters with a short escape in quoted text. Fixed values.
ESCAPES = {"\a": "a", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t", "\v": "v"}


def quoted(text: str | Column) -> Column:
    """Text in double quotes; quotes, backslashes and control characters inside are escaped."""
    plain = col(text)
    escaped = F.replace(F.replace(plain, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in [*range(0x20), 0x7F]:
        mark = ESCAPES.get(chr(code), f"x{code:02x}")
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit("\\" + mark))
    special = plain.rlike(r'[\x00-\x1F\x7F"\\]')
    return F.concat(F.lit('"'), F.when(special, escaped).otherwise(plain), F.lit('"'))
