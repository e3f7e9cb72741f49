"""Ordered per-key calculations that stay spread out when one key holds most of the rows.

A window partitioned by the key alone sends all rows of a key to one task. Here every key is cut
into time slices, the window runs per (key, slice), and what a slice needs from the earlier ones
travels as one extra row per slice (the carry row). The per-slice summaries behind the carry rows
come from ordinary aggregates, which combine on the map side; only the summaries, at most one per
key and slice, meet in a window by key. Results are exact: no row is dropped or estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jobtide.functions.scalars import micros
from jobtide.operators.skew import settled

# Short enough that a key with a third of a very large log still gives slices one task can sort; long
# enough that a common task, done within minutes, has one slice or two.
SLICE_SECONDS = 600
_SLICE = "_slice"
_CARRY = "_carry"


def with_slice(df: DataFrame, ts: str, slice_seconds: int) -> DataFrame:
    return df.withColumn(_SLICE, F.floor(micros(ts) / F.lit(slice_seconds * 1_000_000)))


def _null(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def _pad(carry: DataFrame, like: DataFrame) -> DataFrame:
    """Carry rows in the columns of the data rows, NULL where they have nothing to say."""
    have = set(carry.columns)
    return carry.select(
        *[F.col(f.name) if f.name in have else _null(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def with_neighbour(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    columns: dict[str, str],
    forward: bool = False,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Adds, per ``new: old`` in ``columns``, the value of ``old`` in the row before by ``(ts, tie)``,
    or in the row after with ``forward``."""
    rows = with_slice(df, ts, slice_seconds).withColumn(_CARRY, F.lit(False))
    needed = list(dict.fromkeys([ts, tie, *columns.values()]))
    edge = (F.min if forward else F.max)(F.struct(*needed)).alias("edge")
    by_key = Window.partitionBy(*keys).orderBy(_SLICE)
    neighbour = F.lag(_SLICE).over(by_key) if forward else F.lead(_SLICE).over(by_key)
    summaries = rows.groupBy(*keys, _SLICE).agg(edge).withColumn("target", neighbour)
    carry = summaries.where("target IS NOT NULL").select(
        *keys, F.col("target").alias(_SLICE), *[F.col("edge")[c].alias(c) for c in needed], F.lit(True).alias(_CARRY)
    )
    order = [F.desc(ts), F.desc(tie)] if forward else [F.asc(ts), F.asc(tie)]
    in_slice = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    both = rows.unionByName(_pad(carry, rows))
    seen = both.withColumns({new: F.lag(old).over(in_slice) for new, old in columns.items()})
    return seen.where(~F.col(_CARRY)).drop(_SLICE, _CARRY)


def with_place(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Adds the place from 1 of every row among those of its key by ``order`` (no ties). Rows are cut into ranges of
    ``(key, order)`` and numbered there; a key that spans ranges moves on by the counts of the ranges before, one row each."""
    cut = df.repartitionByRange(key, order).withColumn(_SLICE, F.spark_partition_id())
    rows = settled(cut)
    inside = F.row_number().over(Window.partitionBy(_SLICE, key).orderBy(order))
    earlier = Window.partitionBy(key).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(_SLICE, key).agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(earlier))
    moved = rows.withColumn("_inside", inside).join(counts.where("_before > 0").drop("_n"), [_SLICE, key], "left")
    return moved.withColumn(name, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop(_SLICE, "_inside", "_before")


def with_running_sums(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    values: dict[str, Column],
    inclusive: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """Adds, per ``name: value``, the running sum of the value per key in ``(ts, tie)`` order, with or without the row
    itself. All sums share one pass."""
    own = {f"_v{i}": value.cast("bigint") for i, value in enumerate(values.values())}
    rows = with_slice(df, ts, slice_seconds).withColumns({**own, _CARRY: F.lit(False)})
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    summaries = rows.groupBy(*keys, _SLICE).agg(*[F.sum(v).alias(v) for v in own])
    before = summaries.withColumns({v: F.sum(v).over(earlier) for v in own})
    carry = before.where(" OR ".join(f"{v} <> 0" for v in own)).withColumn(_CARRY, F.lit(True))
    both = rows.unionByName(_pad(carry, rows))
    # The carry row has no time, and NULL sorts first, so it opens its slice.
    frame = Window.partitionBy(*keys, _SLICE).orderBy(F.col(ts), F.col(tie))
    frame = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    summed = both.withColumns({name: F.coalesce(F.sum(v).over(frame), F.lit(0).cast("bigint")) for name, v in zip(values, own, strict=True)})
    return summed.where(~F.col(_CARRY)).drop(_SLICE, _CARRY, *own)


def with_running_sum(
    df: DataFrame,
    keys: list[str],
    ts: str,
    tie: str,
    value: Column,
    name: str,
    inclusive: bool = True,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``with_running_sums`` of one value."""
    return with_running_sums(df, keys, ts, tie, {name: value}, inclusive, slice_seconds)
