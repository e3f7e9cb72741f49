"""Metric samples from text exposition lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide import schemas as S


def parse_metric_text(
    df: DataFrame, prefixes: tuple[str, ...] = S.METRIC_PREFIXES, line: str = "value"
) -> DataFrame:
    """Comment lines dropped, only series with one of the prefixes kept: ``name, labels, sample``."""
    text = F.col(line)
    wanted = reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])
    kept = df.where(~text.startswith("#") & wanted)
    pairs = F.regexp_extract_all(line, F.lit(r'(\w+)="((?:[^"\\]|\\.)*)"'), 0)
    labels = F.map_from_entries(
        F.transform(
            pairs,
            lambda p: F.struct(
                F.regexp_extract(p, r"^(\w+)=", 1).alias("key"), F.regexp_extract(p, r'="(.*)"$', 1).alias("value")
            ),
        )
    )
    number = F.regexp_extract(line, r"^[^{\s]+(?:\{.*\})?\s+(\S+)", 1)
    return kept.select(
        F.regexp_extract(line, r"^([^{\s]+)", 1).alias("name"),
        labels.alias("labels"),
        F.when(number == "+Inf", F.lit(float("inf"))).otherwise(number.try_cast("double")).alias("sample"),
    )


def read_metric_text(spark: SparkSession, path: str, prefixes: tuple[str, ...] = S.METRIC_PREFIXES) -> DataFrame:
    return parse_metric_text(spark.read.text(path), prefixes)
