"""The outbox as a log: pending rows in order, ranges with a mark each, nothing sent past a failure, old marks pruned."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators.skew import settled, settling
from jobtide.operators.sliced import with_place
from jobtide.streaming.sinks import drop_folder, path_exists, subfolders

OUTBOX_RANGE_ROWS = 100_000
#: The first ranges of a batch go one by one; after them each sending holds twice as many as the one before, up to so many rows.
ALONE, GROUP_ROWS = 4, 1_000_000
Deliver = Callable[[DataFrame, int, int], None]
_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class OutboxLog:
    """``published``: marks ``id, published_at`` below ``batch_id=N/range=R``, one folder per sending, named by the last range that
    it held: ranges go in order, so all up to the highest mark are sent. What a batch has to send lies in
    ``published_waiting/batch_id=N``, with a column ``range``, cut into folders ``block=B`` of whole ranges, until the next batch has
    taken over its rest. So neither folders nor sendings grow with the number of ranges, however short these are. ``opened`` is
    applied to the rows once, by the whole cluster, before they are cut into ranges, which may be too short to share out; rows that it
    gets again, as they wait from the batch before, it leaves as they are."""

    published: str
    range_rows: int = OUTBOX_RANGE_ROWS
    keep_seconds: int = 3600
    opened: Callable[[DataFrame], DataFrame] = lambda rows: rows

    def _waiting(self, batch_id: int) -> str:
        return f"{self.published}_waiting/batch_id={batch_id}"

    def _mark(self, batch_id: int, number: int) -> str:
        return f"{self.published}/batch_id={batch_id}/range={number}"

    def _per(self, rows: int) -> int:
        """Ranges that make up so many rows, one at least."""
        return max(1, rows // self.range_rows)

    def _blocks(self, spark: SparkSession, batch_id: int) -> list[int]:
        return sorted(int(name.removeprefix("block=")) for name in subfolders(spark, self._waiting(batch_id)))

    def _next(self, spark: SparkSession, batch_id: int) -> int:
        """The first range of a batch that has no mark."""
        numbers = [int(name.removeprefix("range=")) for name in subfolders(spark, f"{self.published}/batch_id={batch_id}")]
        return max((r + 1 for r in numbers if path_exists(spark, f"{self._mark(batch_id, r)}/_SUCCESS")), default=0)

    def _end(self, spark: SparkSession, batch_id: int) -> int:
        """How many ranges a batch has."""
        blocks = self._blocks(spark, batch_id)
        if not blocks:
            return 0
        last = spark.read.schema("range bigint").parquet(f"{self._waiting(batch_id)}/block={blocks[-1]}")
        return last.agg(F.max("range")).first()[0] + 1

    def unsent(self, spark: SparkSession, batch_id: int) -> list[int]:
        """Ranges of a batch that have no mark."""
        return list(range(self._next(spark, batch_id), self._end(spark, batch_id)))

    def _rows(self, spark: SparkSession, batch_id: int, first: int, end: int) -> DataFrame:
        """Rows of the ranges from ``first`` to before ``end``."""
        per = self._per(OUTBOX_RANGE_ROWS)
        paths = [f"{self._waiting(batch_id)}/block={b}" for b in range(first // per, (end - 1) // per + 1)]
        rows = spark.read.parquet(*paths)
        return rows.where((F.col("range") >= first) & (F.col("range") < end)).drop("range")

    def publish(self, batch: DataFrame, batch_id: int, deliver: Deliver, as_of: str) -> None:
        """Sends what is pending in ``batch`` and what the batch before left, in the order of creation, range after range. The
        first range that cannot be sent ends the batch: it and all later ones wait for the next one. ``deliver(rows, batch_id,
        number)`` gets the rows of one range, or of several that follow each other, with the number of the first. When
        several could not be sent, half as many are tried, down to one. A batch that is run again keeps its ranges and
        begins at the first one without a mark, so at most what one sending held is sent twice."""
        spark = batch.sparkSession
        with settling():
            self._plan(batch, batch_id)
        start = number = self._next(spark, batch_id)
        end, size = self._end(spark, batch_id), 1
        for name in subfolders(spark, f"{self.published}/batch_id={batch_id}"):
            if int(name.removeprefix("range=")) >= number:  # a mark that was cut short
                drop_folder(spark, f"{self.published}/batch_id={batch_id}/{name}")
        while number < end:
            size = min(size, end - number)
            rows = self.opened(self._rows(spark, batch_id, number, number + size))
            try:
                deliver(rows, batch_id, number)
            except Exception:
                if size > 1:
                    _log.warning("outbox batch %s: ranges %s to %s were not sent at once", batch_id, number, number + size - 1, exc_info=True)
                    size //= 2
                    continue
                _log.warning("outbox batch %s stops at range %s", batch_id, number, exc_info=True)
                break
            mark = rows.select("id", F.lit(as_of).cast("timestamp").alias("published_at"))
            mark.write.mode("overwrite").parquet(self._mark(batch_id, number + size - 1))
            number += size
            size = 1 if number - start < ALONE else min(2 * size, self._per(GROUP_ROWS))
        self._prune(spark, batch_id, as_of)

    def _plan(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if path_exists(spark, f"{self._waiting(batch_id)}/_SUCCESS"):
            return
        pending = settled(self.opened(batch.where("published_at IS NULL").drop("published_at")))
        first, end = self._next(spark, batch_id - 1), self._end(spark, batch_id - 1)
        if first < end:
            pending = pending.unionByName(self.opened(self._rows(spark, batch_id - 1, first, end)))
        order = F.struct("created_at", "id")
        placed = with_place(pending.withColumns({"_all": F.lit(0), "_order": order}), "_all", "_order", "_place")
        ranged = placed.withColumn("range", F.floor((F.col("_place") - 1) / self.range_rows)).drop("_all", "_order", "_place")
        ranged = ranged.withColumn("block", F.floor(F.col("range") / self._per(OUTBOX_RANGE_ROWS)))
        ranged.repartition("block").sortWithinPartitions("block", "range", "created_at", "id").write.mode("overwrite").partitionBy("block").parquet(self._waiting(batch_id))

    def _prune(self, spark: SparkSession, batch_id: int, as_of: str) -> None:
        """Plans that nobody can need any more, and marks older than the time they are kept."""
        drop_folder(spark, self._waiting(batch_id - 2))
        names = [n for n in subfolders(spark, self.published) if n.startswith("batch_id=") and int(n.removeprefix("batch_id=")) < batch_id - 1]
        if not names:
            return
        age = F.make_dt_interval(secs=F.lit(self.keep_seconds).cast("decimal(18,6)"))
        ages = spark.read.option("basePath", self.published).parquet(*[f"{self.published}/{n}" for n in names])
        old = ages.groupBy("batch_id").agg(F.max("published_at").alias("at")).where(F.col("at") < F.lit(as_of).cast("timestamp") - age)
        for row in old.collect():
            drop_folder(spark, f"{self.published}/batch_id={row.batch_id}")
