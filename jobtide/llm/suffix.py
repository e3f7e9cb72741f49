"""Removal of repeated passages with a sparse suffix array.

Sorting every suffix would move each text two hundred times, so only sampled suffixes are sorted. From each window of ``LENGTH``
bytes one anchor is chosen by content alone: the place, among the first ones, whose eight bytes have the least hash. Equal windows have
equal anchors at equal offsets, so two equal windows show up as two anchored suffixes with a common beginning, and the
bytes on both sides of the anchors decide. Anchors lie some 70 bytes apart.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import Tidy, scratch, settle, shuffles_end
from jobtide.streaming.sinks import shared_folder

LENGTH = 200
#: Bytes hashed to choose an anchor, places of a window it may take, and the common beginning that all windows of an anchor cover.
GRAM, PLACES = 8, 143
LEAD = LENGTH - PLACES + 1
#: Suffixes with one common beginning beyond this number are decided window by window instead of in one task.
HOT_ROWS = 20_000
#: Suffixes sorted at once inside a task, and bytes of a text looked at at once.
BUCKET_ROWS, SEGMENT = 20_000, 1 << 23

_KEY = "t long, u long"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words_at(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as one number."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first, last)``: each anchor and the windows ``first .. last`` that chose it, in order."""
    out = []
    for begin in range(0, max(len(data) - LENGTH + 1, 0), SEGMENT):
        part = data[begin : begin + SEGMENT + LENGTH - 1]
        windows = len(part) - LENGTH + 1
        h = _mixed(_words_at(part)[: windows + PLACES - 1].copy())
        # The place is the low part of the number, so the leftmost of equal hashes wins.
        h = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        pad = -len(h) % PLACES
        rows = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, PLACES)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(behind[:windows], ahead[PLACES - 1 : PLACES - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [windows - 1]])
        out.append((place[first] + begin, first + begin, last + begin))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _hashes(data: bytes, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of ``length`` bytes from each place on."""
    words = _words_at(data)
    h = np.full(len(at), length + (seed << 32), np.uint64)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
    return h


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Sorting order of equally long byte rows: by their first eight bytes, then ties by the next eight, and so on; only ties move on."""
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))).view(">u8").astype(np.uint64)
    order, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    tied = np.arange(len(rows))
    for k in range(words.shape[1]):
        at = np.lexsort((words[order[tied], k], group[tied]))
        order[tied] = order[tied][at]
        value = words[order[tied], k]
        same = group[tied]
        fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (same[1:] != same[:-1])])
        begins = tied[fresh]
        group[tied] = begins[np.cumsum(fresh) - 1]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        if not len(tied):
            break
    return order


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rank, common)``: rank of each row in sorting order, and the bytes each sorted row shares with the one before it."""
    order = multikey_order(rows)
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return rank, np.concatenate([[-1], common])


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def repeated_windows(lead: list[bytes], back: list[bytes]) -> np.ndarray:
    """``(rows, PLACES)`` booleans: whether the window that begins so many bytes before the anchor occurs in another row.

    ``lead`` are the suffixes from the anchors on, ``back`` the bytes before them, read backwards. A window of offset ``o`` is repeated
    if another row has the same ``LENGTH - o`` bytes ahead and the same ``o`` behind. Sorted order and common
    beginnings of neighbours give the classes of equal bytes at every length.
    """
    n = len(lead)
    ahead, rank_a = np.array([len(x) for x in lead]), None
    behind = np.array([len(x) for x in back])
    rank_a, common_a = _classes(_matrix(lead, LENGTH))
    rank_b, common_b = _classes(_matrix(back, PLACES))
    found = np.zeros((n, PLACES), bool)
    for o in range(PLACES):
        rows = np.flatnonzero((o <= behind) & (LENGTH - o <= ahead))
        if len(rows) < 2:
            continue
        same = np.cumsum(common_a < LENGTH - o)[rank_a[rows]] * (n + 1) + np.cumsum(common_b < o)[rank_b[rows]]
        _, inverse, counts = np.unique(same, return_inverse=True, return_counts=True)
        found[rows, o] = counts[inverse] > 1
    return found


def _texts(df: DataFrame, text_col: str):
    """The distinct texts in a table bucketed by ``t``, so that no later join moves them: ``t``, ``u`` (two hashes that name a text),
    ``data`` (its bytes) and ``copies``. Copies meet in the map task already."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(text_col, F.lit("")).alias("x")).select(F.xxhash64("x").alias("t"), F.xxhash64("x", F.lit(1)).alias("u"), F.col("x").cast("binary").alias("data"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grouped = pa.table([batch.column(0), batch.column(1), pa.array(np.arange(batch.num_rows))], ["t", "u", "row"]).group_by(["t", "u"]).aggregate([("row", "min"), ("row", "count")])
            kept = batch.take(grouped["row_min"].combine_chunks())
            yield pa.record_batch([*kept.columns, grouped["row_count"].combine_chunks()], ["t", "u", "data", "copies"])

    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(combine, f"{_KEY}, data binary, copies long").repartition(many, "t")
    whole = dealt.groupBy("t", "u").agg(F.first("data").alias("data"), F.sum("copies").alias("copies"))
    name = f"jobtide_texts_{uuid.uuid4().hex}"
    path = shared_folder(spark)
    with shuffles_end(spark):
        whole.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(many, "t").sortBy("t").saveAsTable(name)
    return scratch(spark.table(name), path, name)


def _anchored(texts: DataFrame) -> DataFrame:
    """``key`` (hash of an anchor's first bytes), ``t``, ``at``: all anchors of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, places = [], [], []
            for t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(data) >= LENGTH:
                    at, _, _ = anchors(data)
                    keys.append(_hashes(data, at, LEAD).view(np.int64))
                    owner.append(np.full(len(at), t, np.int64))
                    places.append(at)
            if keys:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in (keys, owner, places)], ["key", "t", "at"])

    return texts.select("t", "data").mapInArrow(work, "key long, t long, at long")


def _around(texts: DataFrame, chosen: DataFrame, hot: bool) -> DataFrame:
    """Context of the chosen anchors (``t``, ``at``): rows to sort, or where ``hot`` the hashes of all their windows."""
    by_text = chosen.groupBy("t").agg(F.collect_list("at").alias("at"))
    joined = texts.join(by_text, "t").select("t", "u", "data", "at")

    def rows_of(data: bytes, at: list[int]) -> tuple[np.ndarray, ...]:
        place, first, last = anchors(data)
        keep = np.isin(place, np.array(at))
        return place[keep], first[keep], last[keep]

    def sortable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                out = []
                for t, u, data, at in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns), strict=True):
                    if len(data) >= LENGTH:
                        for p, a, b in zip(*(x.tolist() for x in rows_of(data, at)), strict=True):
                            out.append((data[p : b + LENGTH], data[a:p][::-1], t, u, p))
                if out:
                    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lead", "back", "t", "u", "at"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, u, data, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(data) >= LENGTH:
                    _, first, last = rows_of(data, at)
                    if len(first):
                        s = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
                        cols = (_hashes(data, s, LENGTH, 1).view(np.int64), _hashes(data, s, LENGTH, 2).view(np.int64), np.full(len(s), t), np.full(len(s), u), s)
                        yield pa.record_batch([pa.array(c) for c in cols], ["h", "g", "t", "u", "at"])

    if hot:
        return joined.mapInArrow(windows, f"h long, g long, {_KEY}, at long")
    return joined.mapInArrow(sortable, f"lead binary, back binary, {_KEY}, at long")


def _sorted_spans(rows: DataFrame) -> DataFrame:
    """``t``, ``u``, ``start``, ``end`` of repeated passages from sorted suffixes. Sampled splitters deal ranges of common beginnings to
    tasks, equal beginnings to one; a task sorts bucket by bucket, and a bucket ends only where beginnings differ."""

    def spans(pending: list) -> pa.RecordBatch | None:
        lead, back, t, u, at = zip(*pending, strict=True)
        found = repeated_windows(list(lead), list(back))[:, ::-1]  # now by rising start of the window
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, begin = np.nonzero(edge == 1)
        end = np.nonzero(edge == -1)[1] - 1
        if not len(row):
            return None
        start = np.array(at)[row] - (PLACES - 1)
        cols = (np.array(t)[row], np.array(u)[row], start + begin, start + end + LENGTH)
        return pa.record_batch([pa.array(c) for c in cols], ["t", "u", "start", "end"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list = []
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                pending += zip(*(c.to_pylist() for c in batch.slice(begin, 2_000).columns), strict=True)
                if len(pending) > BUCKET_ROWS:
                    cut = len(pending) - 1
                    while cut and pending[cut][0][:LEAD] == pending[cut - 1][0][:LEAD]:
                        cut -= 1
                    if cut:
                        out = spans(pending[:cut])
                        del pending[:cut]
                        if out is not None:
                            yield out
        if pending and (out := spans(pending)) is not None:
            yield out

    lead = F.substring("lead", 1, LEAD)
    ordered = rows.withColumn("lead58", lead).repartitionByRange("lead58").sortWithinPartitions("lead58").drop("lead58")
    return ordered.mapInArrow(sweep, f"{_KEY}, start long, end long")


def repeats(texts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``t``, ``u``, ``start``, ``end``: spans, overlapping ones too, that cover exactly the bytes of repeated windows."""
    all_ = _anchored(texts)
    often = settle(all_.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    spans = _sorted_spans(_around(texts, all_.join(often.where(F.col("n") <= hot_rows), "key").select("t", "at"), False))
    hot = often.where(F.col("n") > hot_rows)
    if hot.isEmpty():
        return spans
    # Beginnings that most texts share: one row per window, counted with map-side sums.
    windows = _around(texts, all_.join(hot, "key").select("t", "at"), True)
    again = windows.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    found = windows.join(again, ["h", "g"]).select("t", "u", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    return spans.unionByName(found)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def _cleaned(df: DataFrame, text_col: str, hot_rows: int, with_text: bool) -> DataFrame:
    """Per distinct text: ``t``, ``u``, the digest columns, and the kept text if asked for."""
    texts = _texts(df, text_col)
    spans = repeats(texts, hot_rows).groupBy("t").agg(F.collect_list(F.struct("u", "start", "end")).alias("spans"))
    joined = texts.join(spans, "t", "left").select("t", "u", "data", "copies", "spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                out = []
                for t, u, data, copies, spans in zip(*(c.to_pylist() for c in batch.slice(begin, 500).columns), strict=True):
                    gone = _merged([s for s in spans or () if s["u"] == u])
                    if copies > 1 and len(data) >= LENGTH:
                        gone = [(0, len(data))]
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    out.append((t, u, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
                kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["t", "u", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return joined.mapInArrow(work, f"{_KEY}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def repeat_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per row: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` after every byte is removed that a string
    of 200 bytes covers which also starts elsewhere, in this text or another.

    Exact, whatever repeats how often; strings never cross texts. Null texts are empty. Rows with equal texts of 200 bytes or more
    repeat each other, so nothing of them stays; shorter texts lose nothing. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = df.select(F.col(id_col), F.xxhash64(text).alias("t"), F.xxhash64(text, F.lit(1)).alias("u"))
    with Tidy() as tidy:
        done = tidy.keep(settle(_cleaned(df, text_col, hot_rows, False).drop("kept_text")))
    return rows.join(done, ["t", "u"]).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(df: DataFrame, text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with its text cut as ``repeat_digests`` says; characters of which only some bytes stay go. Columns keep
    names and order, whatever they are called. Null texts stay null; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.xxhash64(text).alias("t"), F.xxhash64(text, F.lit(1)).alias("u"))
    with Tidy() as tidy:
        done = tidy.keep(settle(_cleaned(df, text_col, hot_rows, True).where("n_removed > 0").select("t", "u", "kept_text")))
    cut = rows.join(done, ["t", "u"], "left")
    kept = F.when(F.col(f"_row.{text_col}").isNotNull(), F.coalesce("kept_text", f"_row.{text_col}"))
    return cut.select(*[(kept if c == text_col else F.col(f"_row.{c}")).alias(c) for c in df.columns])
