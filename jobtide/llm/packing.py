"""Best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.llm.common import LONGEST_KEY, TextMemo, map_batches, parts_at_spaces, put_in_place, settle, slices, small_batches, worker_cache

SEQUENCE_TOKENS = 4096
END_ID = 1
#: Ranks inside one size class are counted in this many slices, or one for each ``SLICE_ROWS`` rows if more.
SLICES, SLICE_ROWS = 64, 1_000_000

#: Marks that are neither part of a contraction nor of a special token.
_PUNCTUATION = ".,!?;:*%$&#()"
#: Words given to the library in one call.
WORDS_TOGETHER = 500
_PIECE = "piece int, start long, length long, ids_crc32 long"


class WordIds:
    """Ids of whole texts by the tokenizers library, chunk by chunk: the vocabulary drops white space, so
    a text's ids are those of its parts between spaces, which recur. Kept as little-endian 32-bit runs."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = (told["normalizer"] or {}).get("normalizers", [])
        #: Special tokens are looked for in the raw text, so other spellings of them must reach the library as they are.
        self.special = [t["content"].lower() for t in told.get("added_tokens", [])]
        self.by_chunk = not any(c.isspace() for t in self.special for c in t) and any(s.get("type") == "Lowercase" for s in steps) and any(s.get("type") == "Replace" and s["content"] == " " for s in steps) and any(
            s.get("behavior") == "Removed" and "\\s" in s["pattern"]["Regex"] for s in told["pre_tokenizer"].get("pretokenizers", [])
        )
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known = TextMemo(self._chunk, limit)
        #: Ids that end a word: those between two of them are one word's.
        suffix = told["model"].get("end_of_word_suffix")
        ends = [i for token, i in told["model"]["vocab"].items() if suffix and token.endswith(suffix)]
        self.ends = np.isin(np.arange(1 + max(told["model"]["vocab"].values())), ends)

    def _chunk(self, chunk: str) -> bytes:
        """A chunk the cache has not seen. Cuts at punctuation behind an ASCII letter or digit are cuts of the vocabulary too
        (others may be taken apart by NFC, or be no letter to the library), and its letters are lower case,
        so rare chunks are put together from commoner ones."""
        word = chunk.rstrip(_PUNCTUATION)
        if word != chunk and word and word[-1].isascii() and word[-1].isalnum():
            return self.known[word] + self.known[chunk[len(word) :]]
        if chunk.isascii() and (lower := chunk.lower()) != chunk and not any(t in lower for t in self.special):
            return self.known[lower]
        return self._encode(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Keeps the ids of the new words among the chunks, which the library gets many at a time. Only words of the letters a
        to z, once their marks are off, as each of them is one word to the library too."""
        words = {w for c in self.known.new(chunks) if len(c) <= LONGEST_KEY and (w := c.rstrip(_PUNCTUATION).lower()).isascii() and w.isalpha()}
        words = self.known.new(words)
        for begin in range(0, len(words), WORDS_TOGETHER):
            some = words[begin : begin + WORDS_TOGETHER]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) == len(some) and after[-1] == len(ids):
                data, edges = ids.tobytes(), [0, *(4 * after).tolist()]
                for word, a, b in zip(some, edges, edges[1:]):
                    self.known.keep(word, data[a:b])

    def _encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_chunk:
            return self._encode(text)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        """``encode`` of each text; a chunk that recurs in them is asked for once."""
        if not self.by_chunk:
            yield from map(self._encode, texts.to_pylist())
            return
        for some in slices(texts):
            chunks, at, edges = parts_at_spaces(pc.replace_substring(some, "\n", " "))
            self._learn(chunks)
            ids, begins = put_in_place(list(map(self.known.__getitem__, chunks)), at)
            begins = begins[edges].tolist()
            yield from (ids[a:b] for a, b in zip(begins, begins[1:]))


def cut_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document, the end id included: ``id_col``, ``piece``, ``start``,
    ``length``, ``ids_crc32``. Only longer documents are cut, all pieces but the last are full. No shuffle."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = worker_cache(f"words {vocabulary_path}", lambda: WordIds(vocabulary_path))
        rows, piece, start, length, crc = [], [], [], [], []
        end = np.array([end_id], "<u4").tobytes()
        for row, own in enumerate(words.encode_all(batch.column(1))):
            ids = b"".join((own, end))
            for k, at in enumerate(range(0, len(ids), 4 * max_tokens)):
                part = ids[at : at + 4 * max_tokens]
                rows.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        out = [batch.column(0).take(pa.array(rows, "int32")), pa.array(piece, "int32"), *(pa.array(x, "int64") for x in (start, length, crc))]
        return pa.record_batch(out, ["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, {_PIECE}").withColumnRenamed("id", id_col)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the documents of each size go: ``(size, first rank, documents, first sequence, documents per
    sequence, offset)``, in rounds from the largest size down.

    Documents of one size are alike, and so are gaps of one size. A round sweeps the gap classes upward from
    the size: the smallest gap that fits takes documents until no more fit, which is what best fit does
    one by one; ranks say which document meets which gap. Then the gaps move to their new classes.
    The table has a row for each meeting of a size with a run of sequences filled alike. Each size leaves at
    most one run split and opens two, and a run meets only sizes whose sum fits the capacity, so
    the table is bounded by ``2 * capacity * sqrt(2 * capacity)`` rows whatever the number of documents.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of (first sequence, sequences)
    opened = 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        moved: list[tuple[int, tuple[int, int]]] = []

        def fill(gap: int, first: int, many: int) -> int:
            """Fills sequences of one run; returns how many it touched."""
            nonlocal rank, left
            each = gap // size
            whole = min(many, left // each)
            if whole:
                plan.append((size, rank, whole * each, first, each, capacity - gap))
                rank, left = rank + whole * each, left - whole * each
                moved.append((gap - each * size, (first, whole)))
            if whole < many and left:
                plan.append((size, rank, left, first + whole, left, capacity - gap))
                moved.append((gap - left * size, (first + whole, 1)))
                rank, left = rank + left, 0
                return whole + 1
            return whole

        for gap in sorted(g for g in gaps if g >= size):
            runs = gaps.pop(gap)
            while runs and left:
                first, many = runs.pop()
                used = fill(gap, first, many)
                if used < many:
                    runs.append((first + used, many - used))
            if runs:
                gaps[gap] = runs
            if not left:
                break
        if left:
            need = -(-left // (capacity // size))
            fill(capacity, opened, need)
            opened += need
        for gap, run in moved:
            if gap:
                gaps[gap].append(run)
    return plan


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", max_tokens: int = SEQUENCE_TOKENS) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``: best fit from the largest piece down, gapless from 0.

    Bulk-synchronous: size classes are counted by Spark; the rounds match them with gap classes
    (``best_fit_plan``, at most ``max_tokens`` classes, so its state does not grow with the table); then all rows find their place at once
    by size and rank. A size that most rows share is ranked in slices, whose counts give each slice its first rank.
    ``pieces`` is read three times and should be settled.
    """
    sizes = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < s <= max_tokens for s in sizes):
        raise ValueError(f"pieces must have 1 to {max_tokens} tokens")
    slices = max(SLICES, sum(sizes.values()) // SLICE_ROWS)
    order = [id_col, "piece", "start", "ids_crc32"]
    sliced = pieces.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sliced.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    firsts = firsts.select("length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = sliced.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_slice").orderBy(*order)))
    ranked = ranked.join(firsts, ["length", "_slice"]).withColumn("_rank", F.col("_first") + F.col("_in") - 1)
    plan = pieces.sparkSession.createDataFrame(best_fit_plan(sizes, max_tokens), "length long, _from long, _many long, _sequence long, _each long, _offset long")
    met = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_many"))
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "_size")), (F.col("length") == F.col("_size")) & met)
    at = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, F.col("_each")) * F.col("length")).alias("offset"),
    )


def pack_documents(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document with its place: ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    A null or empty text is its end id alone. Repeated rows and equal sizes each get a place of their own; which of
    two equal pieces takes which place is immaterial. An empty table gives no rows. Other columns are ignored.
    """
    with small_batches(df.sparkSession):
        pieces = settle(cut_documents(df, vocabulary_path, id_col, text_col, max_tokens, end_id))
    return pack_pieces(pieces, id_col, max_tokens)
