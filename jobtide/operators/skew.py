"""Joins against a per-key table that hold up when one key has most of the rows."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.streaming.sinks import drop_folder, shared_folder

HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
_SPREAD = 1024


_blocks = threading.local()


@contextmanager
def settling() -> Iterator[None]:
    """What is settled inside the block goes when it ends. For jobs that write all their results there, such as the handler
    of a streaming batch; each thread has blocks of its own."""
    made: list[tuple] = []
    blocks = _blocks.__dict__.setdefault("open", [])
    blocks.append(made)
    try:
        yield
    finally:
        blocks.remove(made)
        for spark, path in made:
            drop_folder(spark, path)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, for rows that must not come out differently when
    they are used twice or when an executor is lost. Read back, its size is known when joins are planned."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    if blocks := getattr(_blocks, "open", None):
        blocks[-1].append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lookup_by_key(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    spread_by: str,
    weight: str = "n",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT_KEYS,
) -> DataFrame:
    """``rows`` left-joined to ``lookup`` (one row per non-null ``key``; ``weight`` = its count in ``rows``).

    The heaviest keys, at most ``max_hot`` and only those above ``hot_rows``, are broadcast. Every key
    left over has at most ``1 / max_hot`` of all rows, so a shuffle by key suits it. Rows already served
    by the broadcast, and rows without a key, take a spread-out second join column that matches nothing:
    they fan out over all partitions instead of meeting in one.
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    hot = lookup.where(F.col(weight) > hot_rows).orderBy(F.col(weight).desc(), F.col(key)).limit(max_hot)
    hot = hot.select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in values])
    served = F.col("_hot").isNotNull() | F.col(key).isNull()
    fan = F.lit(1) + F.pmod(F.xxhash64(spread_by), F.lit(_SPREAD)).cast("int")
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(served, fan).otherwise(F.lit(0)))
    # Always 0, but read from a column: a literal would be folded away and take _salt out of the join keys.
    zero = F.least(F.col(weight), F.lit(0)).cast("int")
    cold = lookup.select(key, zero.alias("_salt"), *[F.col(c).alias(f"_c_{c}") for c in values])
    joined = tagged.join(cold, [key, "_salt"], "left")
    found = [F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(f"_c_{c}")).alias(c) for c in values]
    return joined.select(*rows.columns, *found)
