"""Near-duplicate documents: an exact Jaccard join over word shingles, cut vertically."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import Memo, TextMemo, Tidy, forget, settle, small_batches, worker_cache
from jobtide.llm.components import components

WORDS, PERCENT = 5, 80
#: Sets that share one shingle are compared pair by pair up to this number, beyond it block by block.
PAIR_GROUP, BLOCK_ROWS = 64, 512
#: Bits of the filter that keeps documents without a chance from being moved; a full filter keeps too many, never too few.
FILTER_BITS = 1 << 26
#: Shingles of one fragment, fragments of a pass at least, bytes of text that a shingle stands for, parts that a pair is compared in.
FRAGMENT_TOKENS, LEAST_FRAGMENTS, BYTES_PER_SHINGLE, PAIR_FRAGMENTS = 1_000_000, 16, 6, 2

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes() -> Memo:
    return worker_cache("word hashes", lambda: TextMemo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 300_000))


def shingle_set(text: str | None, known: Memo, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; a shorter text is one shingle, one without words has none.
    Their numeric order is the global order that the join cuts."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    size = min(words, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _MIX + h[k : k + n]
    return np.unique(_mixed(out))


def _key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int | np.ndarray, percent: int = PERCENT):
    """Shingles that a set of ``n`` shares with any partner at least."""
    return -(-n * percent // 100)


def prefix_length(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """``(length, least)``: how many first shingles of a set to look at, and how many of these a partner has among its own.

    If two sets share ``a`` shingles, the first ``k`` shared ones are among the first ``n - a + k`` of each. ``k`` is a fifth of the
    set; a partner's may be that of the smallest set allowed.
    """
    k = -(-n * (100 - percent) // 100)
    smallest = least_overlap(n, percent)
    return min(n, n - smallest + k), max(1, min(k, -(-smallest * (100 - percent) // 100)))


_PACKED = "fragment int, keys binary, counts binary, tokens binary"


def _pack(keys: list[int], sets: list[np.ndarray], fragments: int, span: float, kind) -> Iterator[pa.RecordBatch]:
    """The sets of a batch cut at fixed places of the global order, one row per fragment."""
    if not sets:
        return
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    fragment = np.minimum((tokens.astype(float) * (fragments / span / 2.0**64)).astype(np.int32), fragments - 1)
    order = np.lexsort((tokens, owner, fragment))
    tokens, owner, fragment = tokens[order], owner[order], fragment[order]
    ends = np.searchsorted(fragment, np.arange(fragments + 1))
    ids = np.array(keys, np.int64)
    rows = []
    for f in range(fragments):
        part = slice(ends[f], ends[f + 1])
        if ends[f] < ends[f + 1]:
            sets_here, counts = np.unique(owner[part], return_counts=True)
            rows.append((f, ids[sets_here].tobytes(), counts.astype(np.uint32).tobytes(), kind(tokens[part]).tobytes()))
    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["fragment", "keys", "counts", "tokens"])


def _unpack(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray]:
    """``(key, token)`` of a fragment, each pair once."""
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32)
    tokens = np.frombuffer(b"".join(table["tokens"].to_pylist()), kind)
    owner = np.repeat(keys, counts)
    order = np.lexsort((owner, tokens))
    owner, tokens = owner[order], tokens[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (tokens[1:] != tokens[:-1])
    return owner[fresh], tokens[fresh]


def _frequency(tokens: np.ndarray) -> np.ndarray:
    """Number of sets that have each token, for sorted tokens."""
    _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    return counts[inverse]


def fragments_for(tokens: int) -> int:
    """Fragments of a pass over so many shingles: a fragment has about ``FRAGMENT_TOKENS`` whatever the size of the table."""
    return max(LEAST_FRAGMENTS, -(-tokens // FRAGMENT_TOKENS))


def read_sets(df: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """One look at every text. Rows with ``id``, ``n`` and ``k``, size and key of the shingle set (null where it is empty),
    and rows with a ``fragment``, the first shingles of many sets that lie in it. Shingles are cut to 32 bits inside a
    fragment; a clash only lets a set stay."""
    text = F.col(text_col)
    many = fragments_for((df.agg(F.sum(F.octet_length(text))).first()[0] or 0) // BYTES_PER_SHINGLE)
    kind = df.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_hashes()
        names = ["id", "n", "k", "fragment", "keys", "counts", "tokens"]
        for batch in batches:
            for begin in range(0, batch.num_rows, 3_000):
                part = batch.slice(begin, 3_000)
                sets = [shingle_set(t, known, words) for t in part.column(1).to_pylist()]
                keys = [_key(s) if len(s) else None for s in sets]
                blank = [pa.nulls(len(sets), t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary())]
                yield pa.record_batch([part.column(0), pa.array([len(s) for s in sets], "int64"), pa.array(keys, "int64"), *blank], names)
                firsts = {k: s[: prefix_length(len(s), percent)[0]] for k, s in zip(keys, sets, strict=True) if k is not None}
                for packed in _pack(list(firsts), list(firsts.values()), many, 0.5, lambda t: (t >> np.uint64(20)).astype(np.uint32)):
                    rest = [pa.nulls(len(packed), t) for t in (part.column(0).type, pa.int64(), pa.int64())]
                    yield pa.record_batch([*rest, *packed.columns], names)

    return df.select(F.col(id_col).alias("id"), text.alias("text")).mapInArrow(work, f"id {kind.simpleString()}, n long, k long, {_PACKED}")


def candidates(packed: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Keys of sets that may have a partner: enough of their first shingles occur among the first ones of other sets.
    Every fragment counts the shared shingles of the sets in it; the partial counts are summed per set."""

    def count(table: pa.Table) -> pa.Table:
        owner, tokens = _unpack(table, np.uint32)
        keys, counts = np.unique(owner[_frequency(tokens) > 1], return_counts=True)
        return pa.table([pa.array(keys), pa.array(counts.astype(np.int64))], ["k", "shared"])

    shared = packed.groupBy("fragment").applyInArrow(count, "k long, shared long").groupBy("k").agg(F.sum("shared").alias("shared"))
    fifth = 100 - percent
    smallest = F.ceil(F.col("n") * percent / 100)
    least = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * fifth / 100), F.ceil(smallest * fifth / 100)))
    return sizes.join(shared, "k").where(F.col("shared") >= least).select("k", "n")


def _filter_of(keys: DataFrame) -> bytes:
    """A bitmap of the keys' low bits, compressed; of a fixed size at most, built by Spark's own bitmap aggregate."""
    bit = F.pmod("k", F.lit(FILTER_BITS)) + 1
    parts = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = bytearray(FILTER_BITS // 8)
    for r in parts:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = r["bits"]
    return zlib.compress(bytes(out), 1)


def _may_be(keys: DataFrame, of: Column) -> Column:
    """Whether the hash ``of`` a row may be one of ``keys`` (``k``), by a filter of bounded size."""
    packed = keys.sparkSession.sparkContext.broadcast(_filter_of(keys))

    def look(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for column in hashes:
            bit = column.to_numpy() & (FILTER_BITS - 1)
            yield pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool))

    return F.arrow_udf(look, "boolean")(of)


def token_sets(df: DataFrame, id_col: str, text_col: str, rows: DataFrame, keys: DataFrame, words: int = WORDS) -> DataFrame:
    """``k``, ``n``, ``tokens`` (sorted 64-bit shingles) of the sets with the given keys, one row each. Only texts whose id
    may belong to one are looked at again, by a filter of bounded size; a join removes what it lets through."""
    ids = rows.join(keys, "k", "left_semi").select(F.xxhash64("id").alias("k"))
    packed = df.sparkSession.sparkContext.broadcast(_filter_of(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = np.frombuffer(zlib.decompress(packed.value), np.uint8), _word_hashes()
        for batch in batches:
            bit = batch.column(0).to_numpy() & (FILTER_BITS - 1)
            asked = np.flatnonzero(bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            sets = [shingle_set(t, known, words) for t in batch.column(1).take(pa.array(asked)).to_pylist()]
            found = {_key(s): s for s in sets if len(s)}
            if found:
                yield pa.record_batch([pa.array(list(found), "int64"), pa.array([s.tobytes() for s in found.values()], "binary")], ["k", "tokens"])

    texts = df.select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    sets = texts.mapInArrow(work, "k long, tokens binary").groupBy("k").agg(F.first("tokens").alias("tokens"))
    return sets.join(keys, "k").select("k", "n", "tokens")


def postings(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``token``, ``k``, ``n``, ``own`` (share of shingles that no other set has): the rarest shingles of every set, as many
    as no two linked sets can avoid sharing one of.

    Fragments count how many sets have each shingle. Shingles of one set only come first in the global order and
    need no row; then the rarer, by the frequency and the shingle itself.
    """
    many = fragments_for(sets.agg(F.sum("n")).first()[0] or 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                part = batch.slice(begin, 2_000)
                yield from _pack(part.column(0).to_pylist(), [np.frombuffer(b, np.uint64) for b in part.column(1).to_pylist()], many, 1.0, lambda t: t)

    def count(table: pa.Table) -> pa.Table:
        owner, tokens = _unpack(table, np.uint64)
        often = _frequency(tokens)
        keep = often > 1
        owner, tokens, often = owner[keep], tokens[keep], often[keep].astype(np.uint32)
        order = np.argsort(owner, kind="stable")
        owner, tokens, often = owner[order], tokens[order], often[order]
        keys, begins = np.unique(owner, return_index=True)
        ends = [*begins[1:], len(owner)]
        return pa.table([pa.array(keys), pa.array([tokens[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary()), pa.array([often[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())], ["k", "tokens", "often"])

    shared = sets.select("k", "tokens").mapInArrow(cut, _PACKED).groupBy("fragment").applyInArrow(count, "k long, tokens binary, often binary")
    by_set = sets.select("k", "n").join(shared.groupBy("k").agg(F.collect_list(F.struct("tokens", "often")).alias("parts")), "k")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                keys, sizes, owns, found = [], [], [], []
                for k, n, parts in zip(*(c.to_pylist() for c in batch.slice(begin, 2_000).columns), strict=True):
                    tokens = np.frombuffer(b"".join(p["tokens"] for p in parts), np.uint64)
                    often = np.frombuffer(b"".join(p["often"] for p in parts), np.uint32)
                    room = n - least_overlap(n, percent) + 1 - (n - len(tokens))
                    if room > 0:
                        chosen = tokens[np.lexsort((tokens, often))[:room]]
                        found.append(chosen.view(np.int64))
                        keys.append(np.full(len(chosen), k, np.int64))
                        sizes.append(np.full(len(chosen), n, np.int64))
                        owns.append(np.full(len(chosen), 1 - len(tokens) / n))
                if found:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in (found, keys, sizes, owns)], ["token", "k", "n", "own"])

    return by_set.mapInArrow(first, "token long, k long, n long, own double")


def cut_sets(sets: DataFrame, parts: int = PAIR_FRAGMENTS) -> DataFrame:
    """``k``, ``part``, ``tokens``: every set cut at the same places of the global order, one row for each part it has shingles in."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = np.array([2**64 // parts * i for i in range(1, parts)], np.uint64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                piece, rows = batch.slice(begin, 2_000), []
                for k, tokens in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    ends = [0, *(8 * np.searchsorted(np.frombuffer(tokens, np.uint64), borders)).tolist(), len(tokens)]
                    rows += [(k, p, tokens[a:b]) for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if a < b]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["k", "part", "tokens"])

    return sets.select("k", "tokens").mapInArrow(cut, "k long, part int, tokens binary")


def overlaps(pairs: DataFrame, cut: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (``a``, ``b``, with their sizes ``na``, ``nb``) that are linked. A pair meets part by part of the global
    order; each part's overlap is counted on its own, and the counts are summed per pair."""
    left = pairs.select("a", "b").join(cut.select(F.col("k").alias("a"), "part", F.col("tokens").alias("x")), "a")
    both = left.join(cut.select(F.col("k").alias("b"), "part", F.col("tokens").alias("y")), ["b", "part"]).select("a", "b", "x", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 2_000):
                part, shared = batch.slice(begin, 2_000), []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    shared.append(int((both[1:] == both[:-1]).sum()))
                yield pa.record_batch([*part.columns[:2], pa.array(shared, "int64")], ["a", "b", "shared"])

    partial = both.mapInArrow(count, "a long, b long, shared long")
    summed = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared")).join(pairs, ["a", "b"])
    return summed.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _fits(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between different components of sets that common shingles bring together, from rows
    ``token``, ``k``, ``c``. Such groups may be of any size: the sets outside a group's largest component meet each
    other and that component in blocks, and of the links of two blocks only a spanning part leaves the task."""
    heads = open_.groupBy("token").agg(F.min("k").alias("h"))
    group = components(open_.join(heads, "token").select(F.col("k").alias("a"), F.col("h").alias("b"))).withColumnsRenamed({"node": "k", "component": "g"})
    members = settle(open_.select("k", "c").distinct().join(group, "k"))
    largest = members.groupBy("g", "c").agg(F.count("*").alias("size")).groupBy("g").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.max("size").alias("mains"), F.sum("size").alias("all"))
    sized = members.join(largest, "g").select("k", "g", "c", (F.col("c") == F.col("main")).alias("main"), F.ceil(F.col("mains") / BLOCK_ROWS).alias("p"), F.ceil((F.col("all") - F.col("mains")) / BLOCK_ROWS).alias("q"))
    part = F.pmod(F.xxhash64("k"), F.when(F.col("main"), F.col("p")).otherwise(F.col("q")))
    sized = sized.where("q > 0").withColumn("part", part)
    # Task (i, true, j): part i of the others against part j of the largest component; (i, false, j): against others.
    as_main = F.expr("transform(sequence(0L, q - 1), i -> struct(i as i, true as with_main, part as j))")
    as_other = F.expr(
        "concat(transform(sequence(0L, p - 1), j -> struct(part as i, true as with_main, j as j)),"
        " transform(sequence(0L, q - 1), o -> struct(least(part, o) as i, false as with_main, greatest(part, o) as j)))"
    )
    dealt = sized.select("k", "g", "c", "main", "part", F.explode(F.when(F.col("main"), as_main).otherwise(as_other)).alias("t"))
    wide = dealt.select("k", "g", "c", "main", "part", "t.*").join(sets.select("k", "tokens"), "k")

    def compare(table: pa.Table) -> pa.Table:
        i, with_main, j = table["i"][0].as_py(), table["with_main"][0].as_py(), table["j"][0].as_py()
        keys, comps, main, part = (table[c].to_numpy(zero_copy_only=False) for c in ("k", "c", "main", "part"))
        tokens = [np.frombuffer(b, np.uint64) for b in table["tokens"].to_pylist()]
        sizes = np.array([len(t) for t in tokens])
        left = np.flatnonzero(~main & (part == i))
        right = np.flatnonzero((main == with_main) & (part == j))
        held = np.concatenate([tokens[x] for x in left]) if len(left) else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(left)), sizes[left])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        label = {int(c): int(c) for c in comps}

        def root(c: int) -> int:
            while label[c] != c:
                label[c] = label[label[c]]
                c = label[c]
            return c

        links = []
        for y in right:
            begin, end = np.searchsorted(held, tokens[y], "left"), np.searchsorted(held, tokens[y], "right")
            counts = end - begin
            at = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            shared = np.bincount(owner[at], minlength=len(left))
            for x in left[100 * shared >= percent * (sizes[left] + sizes[y] - shared)]:
                a, b = root(int(comps[x])), root(int(comps[y]))
                if a != b:
                    label[max(a, b)] = min(a, b)
                    links.append((int(keys[x]), int(keys[y])))
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return wide.groupBy("g", "i", "with_main", "j").applyInArrow(compare, "a long, b long")


def link_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(node, component)`` of all sets that have a link; no component is split for a link that was not looked at.

    First every set is compared with one other: of the sets at the head of its shingles, the one it meets most often. The head of a shingle
    is its set with the fewest shingles of its own, as the source of a group of copies has, so most of a group is in one component
    without comparing its pairs. Then sets of different components that still share a shingle are compared, pair by pair
    where few sets have the shingle, block by block where many do.
    """
    rows, cut = settle(postings(sets, percent)), settle(cut_sets(sets))
    head = F.min_by(F.struct("k", "n"), F.struct("own", "k"))
    heads = rows.groupBy("token").agg(head.alias("h")).select("token", F.col("h.k").alias("hk"), F.col("h.n").alias("hn"))
    met = rows.join(heads, "token").where((F.col("k") != F.col("hk")) & _fits("n", "hn", percent)).groupBy("k", "hk").agg(F.count("*").alias("often"), F.first("n").alias("n"), F.first("hn").alias("hn"))
    best = met.groupBy("k").agg(F.max_by(F.struct("hk", "n", "hn"), F.struct("often", "hk")).alias("m"))
    turned = F.col("k") > F.col("m.hk")
    way = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x))
    pairs = settle(best.select(way("k", "m.hk").alias("a"), way("m.hk", "k").alias("b"), way("m.n", "m.hn").alias("na"), way("m.hn", "m.n").alias("nb")).distinct())
    first = settle(overlaps(pairs, cut, percent))
    of = components(first).withColumnsRenamed({"node": "k", "component": "c"})

    now = settle(rows.select("token", "k", "n").join(of, "k", "left").withColumn("c", F.coalesce("c", "k")))
    open_ = settle(now.groupBy("token").agg(F.count("*").alias("size"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("token", "size"))
    few = now.join(open_.where(F.col("size") <= PAIR_GROUP), "token").select("token", "k", "n", "c")
    other = few.select("token", F.col("k").alias("k2"), F.col("n").alias("n2"), F.col("c").alias("c2"))
    near = few.join(other, "token").where((F.col("k") < F.col("k2")) & (F.col("c") != F.col("c2")) & _fits("n", "n2", percent))
    more = near.select(F.col("k").alias("a"), F.col("k2").alias("b"), F.col("n").alias("na"), F.col("n2").alias("nb")).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    found = overlaps(settle(more), cut, percent)
    blocks = _block_links(settle(now.join(open_.where(F.col("size") > PAIR_GROUP), "token").select("token", "k", "c")), sets, percent)
    return components(first.unionByName(found).unionByName(blocks))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles`` and ``component_id``: the least id reachable by links of ``percent`` hundredths Jaccard similarity
    or more, the own one included. One row per row of ``df``.

    Exact: vertical fragments of the global shingle order count partial overlaps, which are summed per set and prove most
    documents to be without a partner; the others are paired by ``link_sets``, which sums the partial overlaps of a pair's
    fragments. Equal sets are one from the start.

    Words are runs without ASCII white space, A-Z lower-cased. A text with fewer words is one shingle; a null, empty
    or blank one has none and links with nothing. A null id links nothing and gets a null component. Rows that repeat an id share its component;
    an empty table gives no rows; other columns are ignored.
    """
    with Tidy() as scratch, small_batches(df.sparkSession):
        read = settle(read_sets(df, id_col, text_col, words, percent))
        rows = scratch.keep(settle(read.where("fragment is null").select("id", "n", "k")))
        sizes = settle(rows.where("k is not null").groupBy("k").agg(F.first("n").alias("n"), F.min("id").alias("id")))
        keys = settle(candidates(read.where("fragment is not null").select("fragment", "keys", "counts", "tokens"), sizes.select("k", "n"), percent))
        forget(read)
        sets = settle(token_sets(df, id_col, text_col, rows, keys, words))
        of = link_sets(sets, percent)
        named = sizes.join(of.withColumnRenamed("node", "k"), "k", "left").withColumn("c", F.coalesce("component", "k"))
        least = named.groupBy("c").agg(F.min("id").alias("component_id"))
        named = scratch.keep(settle(named.join(least, "c").select("k", "component_id")))
    alone = rows.withColumn("_key", F.coalesce(F.col("k"), F.xxhash64("id")))
    joined = alone.join(named.withColumnRenamed("k", "_key"), "_key", "left")
    component = F.when(F.col("k").isNotNull() & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the least of their component, one for each id; rows with a null id stay. Only rows that may be
    left out, by a filter of bounded size, are moved to be joined with the ids that are; the others stay where they are read."""
    with Tidy() as scratch:
        found = near_duplicates(df, id_col, text_col, words, percent).where(F.col(id_col).isNotNull())
        of = scratch.keep(settle(found.select(F.col(id_col).alias("_id"), "component_id")))
    gone = of.where("_id != component_id").select(F.col("_id").alias(id_col)).distinct()
    may = _may_be(gone.select(F.xxhash64(id_col).alias("k")), F.xxhash64(id_col))
    rest = df.where(~may).union(df.where(may).join(gone, id_col, "left_anti").select(*df.columns))
    if of.groupBy("_id").count().where("count > 1").isEmpty():
        return rest
    return rest.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(rest.where(F.col(id_col).isNull()))
