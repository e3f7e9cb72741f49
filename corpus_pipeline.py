"""A pipeline over ``documents`` made of the operators of ``jobtide.llm``.

Every stage takes nulls in any column, texts of any length, repeated rows, an empty table (which gives an empty one) and further
columns of any name; what becomes of them is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import jaccard, packing, pii, quality, suffix
from jobtide.llm.common import Tidy, forget, settle
from jobtide.llm.queries import WORD_BPE


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the bounds of their language and source. Null and blank texts have no words and
    go; a null language or source is a group of its own; equal rows share their verdict, and a tie at a bound stays."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id. Texts without words link with nothing and stay; rows
    with a null id stay; of rows that repeat an id one stays."""
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start more than once; their length follows. Null texts stay null; equal long texts, ids
    equal or not, repeat each other and become empty."""
    return _with_length(suffix.remove_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; their length follows. Null and empty texts stay as they are, equal
    texts change alike."""
    return _with_length(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its sequence and offset. A null or empty text is one piece, the end id alone; repeated
    rows and ids are documents of their own."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

#: SQL cannot express token ids, packing or bootstrapped patterns; ``tests/llm`` compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, each stage working on all that the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        if name == STAGES[-1][0]:
            return stage(spark, docs, sf_dir)
        # What a stage has settled on its way goes with its input.
        with Tidy() as tidy:
            before, docs = docs, tidy.keep(settle(stage(spark, docs, sf_dir)))
        if hasattr(before, "settled_at"):
            forget(before)
    return docs
