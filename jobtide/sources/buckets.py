"""A keyed table on files that grows by batches: hash buckets, a few parts each, compacted bucket by bucket.

``root/batch_id=N/bucket=B`` holds the rows that batch ``N`` brought for bucket ``B``; ``root_parts/batch_id=N`` says which batches
make up each bucket from then on. A batch writes to the buckets of its keys only. A bucket that has too many parts is
folded into one by the batch that finds it so, so a bucket never has more than ``most_parts``, however long the history.
Readers of version ``N`` see ``root_parts/batch_id=N``; it is written last, so a batch that failed half way is run again over what it left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.streaming.sinks import drop_folder, path_exists, write_batch

BUCKETS, MOST_PARTS = 64, 8
#: Bitmaps of a bucket's membership filter, each of 32,768 bits. A full filter costs reads, never results.
SLOTS = 16
_SLOT_BITS = 32_768

Parts = dict[int, list[int]]


@dataclass(frozen=True)
class BucketStore:
    """``order``: columns that say which of the rows of a key is the latest; the latest one is the key's row."""

    root: str
    key: str
    order: tuple[str, ...]
    buckets: int = BUCKETS
    most_parts: int = MOST_PARTS
    with_filter: bool = False

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def parts(self, spark: SparkSession, version: int) -> Parts:
        """Batches per bucket, at most ``most_parts`` for each of the ``buckets``."""
        path = f"{self.root}_parts/batch_id={version}"
        if not path_exists(spark, path):
            return {}
        rows = spark.read.schema("bucket int, parts array<bigint>").parquet(path).collect()
        return {r.bucket: list(r.parts) for r in rows}

    def _paths(self, parts: Parts, buckets: list[int], folder: str = "") -> list[str]:
        return [f"{self.root}{folder}/batch_id={n}/bucket={b}" for b in buckets if b in parts for n in parts[b]]

    def _fold(self, rows: DataFrame) -> DataFrame:
        # Dealt by key first: the rows are sorted for the aggregate in shares of the shuffle, not in those of the files.
        columns, rows = rows.columns, rows.repartition(self.key)
        latest = F.max_by(F.struct(*columns), F.struct(*self.order)).alias("_row")
        return rows.groupBy(F.col(self.key).alias("_key")).agg(latest).select("_row.*")

    def read(self, spark: SparkSession, version: int, schema, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some. Buckets of one part are read as they are, with filters reaching the
        scan; only those with changes are folded."""
        parts = self.parts(spark, version)
        chosen = sorted(parts) if buckets is None else [b for b in buckets if b in parts]
        reader = spark.read.schema(schema)
        single = self._paths(parts, [b for b in chosen if len(parts[b]) == 1])
        several = self._paths(parts, [b for b in chosen if len(parts[b]) > 1])
        found = [reader.parquet(*single)] if single else []
        found += [self._fold(reader.parquet(*several))] if several else []
        if not found:
            return spark.createDataFrame([], schema)
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def replace(self, rows: DataFrame, version: int, sort: tuple[str, ...] = ()) -> None:
        """A whole new version, one part per bucket."""
        self._write(rows, version, sort)
        spark = rows.sparkSession
        buckets = [r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect()]
        self._commit(spark, {b: [version] for b in buckets}, version)

    def append(self, rows: DataFrame, version: int, sort: tuple[str, ...] = ()) -> None:
        """Version ``version`` out of the one before and ``rows``, with at most one row per key among them."""
        spark, schema = rows.sparkSession, rows.schema
        before = self.parts(spark, version - 1)
        # What is written must be what the parts say, so the rows are settled first if a bucket has to be folded.
        touched = sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())
        full = [b for b in touched if len(before.get(b, ())) >= self.most_parts]
        if full:
            old = spark.read.schema(schema).parquet(*self._paths(before, full))
            in_full = self.bucket().isin(full)
            rows = rows.where(~in_full).unionByName(self._fold(rows.where(in_full).unionByName(old)))
        self._write(rows, version, sort)
        after = {**before, **{b: [version] if b in full else [*before.get(b, ()), version] for b in touched}}
        self._commit(spark, after, version)
        self._forget(spark, version)

    def _write(self, rows: DataFrame, version: int, sort: tuple[str, ...]) -> None:
        # A bucket goes to several tasks when there are more partitions than buckets, so a task's share does not follow from
        # the number of buckets. Adaptive execution puts small shares together.
        conf = rows.sparkSession.conf
        partitions = conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions")
        spread = max(1, int(partitions) // self.buckets)
        share = F.pmod(F.xxhash64(F.lit(2), F.col(self.key).cast("string")), F.lit(spread))
        dealt = rows.withColumns({"bucket": self.bucket(), "_share": share}).repartition("bucket", "_share").drop("_share")
        dealt = dealt.sortWithinPartitions("bucket", *sort)
        write_batch(dealt, self.root, version, ("bucket",))
        if self.with_filter:
            bits = _filter_place(self.key)
            marks = dealt.groupBy("bucket", F.bitmap_bucket_number(bits).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bits)).alias("bits"))
            write_batch(marks, f"{self.root}_filter", version, ("bucket",))

    def _commit(self, spark: SparkSession, parts: Parts, version: int) -> None:
        rows = spark.createDataFrame(sorted(parts.items()), "bucket int, parts array<bigint>")
        write_batch(rows.coalesce(1), f"{self.root}_parts", version)

    def _forget(self, spark: SparkSession, version: int) -> None:
        """Parts that the version before no longer had are read by nobody: a batch that is run again begins at that one."""
        older, kept = self.parts(spark, version - 2), self.parts(spark, version - 1)
        for b, numbers in older.items():
            for n in set(numbers) - set(kept.get(b, ())):
                for folder in ("", "_filter"):
                    drop_folder(spark, f"{self.root}{folder}/batch_id={n}/bucket={b}")
        drop_folder(spark, f"{self.root}_parts/batch_id={version - 3}")

    def lookup(self, keys: DataFrame, version: int, schema) -> DataFrame:
        """The stored rows of the given keys. Keys ask the filters of their own buckets first, ten bits or so for each
        stored key; only buckets with a key that may be there are read."""
        spark = keys.sparkSession
        asked = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        found = self.read(spark, version, schema, self.hit_buckets(asked, version))
        return found.join(asked, self.key, "left_semi")

    def hit_buckets(self, asked: DataFrame, version: int) -> list[int]:
        """Buckets that may hold one of the distinct keys."""
        spark = asked.sparkSession
        parts = self.parts(spark, version)
        bits = _filter_place(self.key)
        placed = asked.select(self.bucket().alias("bucket"), F.bitmap_bucket_number(bits).alias("slot"), F.bitmap_bit_position(bits).alias("at")).distinct()
        named = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
        paths = self._paths(parts, named, "_filter" if self.with_filter else "")
        if not paths or not self.with_filter:
            return [b for b in named if b in parts]
        marks = spark.read.schema("slot bigint, bits binary, bucket int").option("basePath", f"{self.root}_filter").parquet(*paths)
        byte = F.conv(F.hex(F.expr("substring(bits, CAST(at DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
        hit = placed.join(marks, ["bucket", "slot"]).where(byte.bitwiseAND(F.pow(F.lit(2), F.col("at") % 8).cast("int")) != 0)
        return sorted(r.bucket for r in hit.select("bucket").distinct().collect())


def _filter_place(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), F.col(key).cast("string")), F.lit(SLOTS * _SLOT_BITS)) + 1
