"""Set operations on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_deltas(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, by column name; duplicates stay."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def delete_keys(df: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    return df.join(keys.select(on), on, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with the number of times they were lost or gained; empty when a rewrite kept everything.

    Counting on both sides of one aggregate does the work of two multiset differences with one shuffle.
    """
    columns = old.columns
    tagged = old.select(*columns, F.lit(-1).alias("_d")).unionByName(new.select(*columns, F.lit(1).alias("_d")))
    change = tagged.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    return change.select(*columns, F.when(F.col("_d") < 0, "lost").otherwise("gained").alias("change"), F.abs("_d").alias("times"))
