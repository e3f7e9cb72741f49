"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.streaming.sinks import shared_folder

#: ASCII white space as the word pattern ``[^\x20\x09-\x0D]+`` leaves it out.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker, kept between tasks until another one is asked for, so that what one operator has
    cached does not stay while the next one works: a cache that calls a method of its owner is a cycle, which only a
    collection ends, and Arrow holds on to what was freed. Code travels to the workers by value, so a plain module
    variable would be made anew for each task."""
    place = sys.modules.setdefault("_jobtide_worker", types.ModuleType("_jobtide_worker"))
    if getattr(place, "name", None) != name:
        place.held = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        place.name, place.held = name, make()
    return place.held


class Memo(dict):
    """A cache of ``find(key)`` with at most ``limit`` keys: when half of them are new, those not asked for since
    the last time go."""

    def __init__(self, find: Callable, limit: int = 600_000):
        super().__init__()
        self.find, self.limit, self.older = find, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        return self.keep(key, value)

    def keep(self, key, value):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value

    def new(self, keys: Iterable) -> list:
        """Those of the keys that are not in the cache."""
        return [k for k in keys if k not in self and k not in self.older]


#: Longer texts are not kept in caches: a document without a blank may be one.
LONGEST_KEY = 256


class TextMemo(Memo):
    """A ``Memo`` of texts that leaves long ones out, which bounds its bytes."""

    def __missing__(self, key):
        return self.find(key) if len(key) > LONGEST_KEY else super().__missing__(key)


#: Bytes of text whose parts are looked up together.
TOGETHER = 1 << 23


def slices(texts: pa.Array, limit: int = TOGETHER) -> Iterator[pa.Array]:
    """``texts`` in runs of about ``limit`` bytes; a longer text is in a run with those before it."""
    run = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // limit
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    for a, b in zip(edges, edges[1:]):
        yield texts.slice(a, b - a)


def parts_at_spaces(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``(parts, at, edges)``: the distinct parts between spaces, the part at each place, and the places where each text
    begins, with their number at the end. A part that recurs is looked up once by its users; Arrow puts the finds in place."""
    cut = pc.split_pattern(texts, " ")
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().copy(), cut.offsets.to_numpy()


def put_in_place(found: list[bytes], at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """What was found for the part at each place, end to end, and the byte where each place begins, with their number at the end."""
    placed = pa.array(found, pa.large_binary()).take(pa.array(at))
    edges = np.frombuffer(placed.buffers()[1], np.int64)[placed.offset : placed.offset + len(placed) + 1]
    data = placed.buffers()[2]
    return memoryview(data if data is not None else b""), edges


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with one function per record batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def shuffles_end(spark: SparkSession) -> AbstractContextManager[None]:
    """What is written inside the block has its shuffle files removed as soon as it is written, instead of when the driver collects its
    garbage, so that the steps of an operator do not add up on disk. The caller's setting returns."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, limit: int = TOGETHER) -> AbstractContextManager[None]:
    """What is written inside the block reaches Python in Arrow batches of about ``limit`` bytes, not only of so many rows: the JVM and the
    worker each hold a batch or two, so long rows cost no more memory than short ones. The caller's setting returns."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def settle(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, for rows that several steps use. The files
    are not tied to an executor, and later plans begin at them."""
    path = shared_folder(df.sparkSession)
    with shuffles_end(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path)
    return scratch(rows, path)


def scratch(rows: DataFrame, path: str, table: str | None = None) -> DataFrame:
    """``rows``, whose files (and table of that name) may go once nothing reads them any more."""
    rows.settled_at, rows.settled_as = path, table
    if Tidy._open:
        Tidy._open[-1].made.append(rows)
    return rows


class Tidy:
    """Removes what was settled inside a ``with`` block when it ends, but for the frames given to ``keep``."""

    _open: list[Tidy] = []

    def __enter__(self) -> Tidy:
        self.made: list[DataFrame] = []
        Tidy._open.append(self)
        return self

    def keep(self, rows: DataFrame) -> DataFrame:
        self.made = [m for m in self.made if m is not rows]
        if len(Tidy._open) > 1:
            Tidy._open[-2].made.append(rows)
        return rows

    def __exit__(self, *problem) -> None:
        Tidy._open.remove(self)
        forget(*self.made)


def forget(*settled: DataFrame) -> None:
    """Removes the files of settled rows that nothing reads any more."""
    for rows in settled:
        if rows.settled_as:
            rows.sparkSession.sql(f"DROP TABLE IF EXISTS {rows.settled_as}")
        path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(rows.settled_at)
        path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
