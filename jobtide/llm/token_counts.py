"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import Memo, map_batches, worker_cache
from jobtide.llm.vocabulary import Vocabulary

MAX_TOKENS = 1024


def merged_length(piece: bytes, symbol: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Number of tokens of one piece: its bytes minus the merges made. Symbols are a doubly linked list;
    a heap holds ``(rank, left place)`` of adjacent pairs, and entries that a merge made stale are skipped."""
    n = len(piece)
    if n < 2:
        return n
    ids = [symbol[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get((ids[i], ids[i + 1]))
        if found:
            heap.append((found[0], i))
    heapq.heapify(heap)
    count = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n:
            continue
        found = merges.get((ids[i], ids[j]))
        if not found or found[0] != rank:
            continue
        ids[i], ids[j] = found[1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        count -= 1
        for left in (before[i], i):
            if left >= 0 and after[left] < n and (found := merges.get((ids[left], ids[after[left]]))):
                heapq.heappush(heap, (found[0], left))
    return count


class Counter:
    """Token count of whole texts; counts of pieces and chunks are kept in bounded caches."""

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        pieces = Memo(lambda piece: merged_length(piece.encode(), v.symbol, v.merges))
        self.block = lambda s: sum(map(pieces.__getitem__, v.cut(s)))
        self.after_space = Memo(lambda chunk: self.block(" " + chunk))

    def count(self, text: str) -> int:
        total = 0
        for special, segment in self.vocabulary.segments(text):
            if special:
                total += 1
                continue
            for block in self.vocabulary.blocks(segment):
                chunks = self.vocabulary.chunks(block)
                if chunks is None:
                    total += self.block(block)
                else:
                    total += self.block(chunks[0]) + sum(map(self.after_space.__getitem__, chunks[1]))
        return total


def count_tokens(df: DataFrame, vocabulary_path: str, text_col: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``df`` plus ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (``n_tokens > max_tokens``).

    ``vocabulary_path`` is a byte-level BPE file that every worker can read. No shuffle, no identifiers:
    a row is counted where it is read. A null text counts as empty (0 bytes, 0 tokens). Repeated rows and
    ties each keep their row; an empty table gives no rows; very long texts are counted in blocks. Columns
    of ``df`` with the names of the added ones are replaced.
    """
    kept = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    packed = df.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = worker_cache(f"counter {vocabulary_path}", lambda: Counter(vocabulary_path))
        texts = pc.fill_null(batch.column(1), "")
        counts = [counter.count(t) for t in texts.to_pylist()]
        return pa.record_batch([batch.column(0), pc.binary_length(texts).cast("int64"), pa.array(counts, "int64")], ["row", "n_bytes", "n_tokens"])

    done = map_batches(packed, work, schema)
    return done.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
