"""Message headers: ``array<struct<key:string,value:binary>>``, the shape Spark's message source uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.functions.scalars import col


def header(key: str, value: str | Column) -> Column:
    return F.struct(F.lit(key).alias("key"), col(value).cast("string").cast("binary").alias("value"))


def build_headers(**values: str | Column) -> Column:
    return F.array(*[header(k, v) for k, v in values.items()])


def get_header(headers: str | Column, key: str) -> Column:
    """Text of the first header with that key, the empty string when there is none."""
    hits = F.filter(col(headers), lambda h: h["key"] == F.lit(key))
    return F.coalesce(F.get(hits, F.lit(0))["value"].cast("string"), F.lit(""))


def set_header(headers: str | Column, key: str, value: str | Column) -> Column:
    """The first header with that key gets the value in place; without one it goes to the end."""
    entries = col(headers)
    fresh = header(key, value)
    place = F.array_position(F.transform(entries, lambda h: h["key"]), key)
    replaced = F.transform(entries, lambda h, i: F.when(i + 1 == place, fresh).otherwise(h))
    return F.when(place > 0, replaced).otherwise(F.concat(entries, F.array(fresh)))


def header_keys(headers: str | Column) -> Column:
    return F.transform(col(headers), lambda h: h["key"])
