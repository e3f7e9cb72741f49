"""Near-duplicate vectors by lattice hashing."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import settle
from jobtide.llm.components import components

MIN_COSINE = 0.98
#: Tables, E8 blocks of each table's key, and neighbouring lattice points that each vector also probes.
TABLES, BLOCKS, PROBES = 6, 2, 8
#: Length, in lattice units, of the projected difference of two vectors at the least cosine.
REACH = 0.35
#: Vectors of one bucket in one task; larger buckets are compared block by block.
BLOCK_ROWS = 1024


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all entries of a half with an even number of minus signs."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(found)


ROOTS = roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the worst entry the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def bucket_keys(unit: np.ndarray, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, min_cosine: float = MIN_COSINE, seed: int = 7) -> np.ndarray:
    """``(rows, tables, 1 + probes)`` keys of unit vectors: the own cell, then the neighbouring cells that are nearest."""
    n, dim = unit.shape
    random = np.random.default_rng([seed, dim])
    scale = REACH / math.sqrt(8 * (2 - 2 * min_cosine))
    out = np.empty((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        matrix = random.standard_normal((dim, 8 * blocks)) * scale
        shift = random.uniform(0, 1, 8 * blocks)
        weights = random.integers(-(2**62), 2**62, 8 * blocks) * 2 + 1
        y = unit @ matrix + shift
        own = np.zeros(n, np.int64)
        gains, moves = [], []
        for k in range(blocks):
            part = y[:, 8 * k : 8 * k + 8]
            point = nearest_e8(part)
            w = weights[8 * k : 8 * k + 8]
            own += ((2 * point).astype(np.int64) * w).sum(1)
            gains.append((part - point) @ ROOTS.T)
            moves.append(((2 * ROOTS).astype(np.int64) * w).sum(1))
        gain, move = np.hstack(gains), np.concatenate(moves)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes] if probes else np.empty((n, 0), int)
        out[:, t, 0] = own
        out[:, t, 1:] = own[:, None] + move[best]
        out[:, t] ^= np.int64(0x1E3779B97F4A7C15 * (t + 1) % (1 << 62))
    return out


def _units(vectors: pa.Array) -> np.ndarray:
    flat = np.asarray(vectors.values if vectors.offset == 0 else vectors.flatten(), float)
    rows = flat.reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least linked row of each row, by passing labels along and jumping."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """``id_col``, ``n_links`` (other vectors of the same label with a cosine of at least ``min_cosine`` that were found),
    ``component_id`` (least id reachable by links) and ``kept`` (it is the own id). One row per row of ``df``.

    Vectors are projected at random and decoded to E8 lattice points in several tables; each also probes the
    neighbouring points nearest to it. Vectors that meet in a bucket are verified in double precision; a pair is counted in the
    first bucket in which it meets, so no pairs leave a task: only counts and links that span what was found. Equal
    vectors are one until the end. A bucket of any size is compared whole, in blocks.

    A null id, label or vector, a zero vector and one with null or non-finite entries link with nothing. Vectors
    of different lengths never link. Rows that repeat an id are vectors of their own, equal or not. An empty table gives no rows;
    columns of ``df`` besides the three are not looked at.
    """
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, entry) & F.exists(vector_col, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("id"), F.when(usable, F.col(label_col)).alias("label"), F.when(usable, F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0))).alias("v"))
    # Twins by value: the digest of label and entries stands for them in the joins.
    rows = rows.withColumn("twin", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join("v", ",")), 256)))
    twins = rows.where("twin is not null").groupBy("twin").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("label").cast("string").alias("label"), F.first("v").alias("v"))
    # A class has a number of its own from here on, as ids may be shared by vectors that differ.
    classes = settle(twins.withColumn("id", F.monotonically_increasing_id()))
    counted = _found(classes, min_cosine)
    links = counted.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
    of = components(links).withColumnRenamed("node", "id")
    sums = counted.where("n is not null").groupBy("id").agg(F.sum("n").alias("n"))
    done = classes.select("twin", "id", "least", "copies").join(sums, "id", "left").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    done = settle(done.select("twin", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    first = done.groupBy("component").agg(F.min("least").alias("component_id"))
    done = done.join(first, "component").select("twin", "n_links", "component_id")
    alone = F.coalesce("twin", F.concat(F.lit("none "), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    joined = rows.select("id", alone.alias("twin")).join(settle(done), "twin", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _found(classes: DataFrame, min_cosine: float) -> DataFrame:
    """Partial results of all buckets: ``(id, n, null)`` counts and ``(id, null, other)`` links."""

    def place(batches):
        for batch in batches:
            lengths = np.diff(np.asarray(batch.column(1).offsets))
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                keys = bucket_keys(_units(part.column(1)), min_cosine=min_cosine)
                n, per = len(part), keys.shape[1] * keys.shape[2]
                own = np.tile(np.arange(keys.shape[2]) == 0, n * keys.shape[1])
                yield pa.record_batch([part.column(0).take(pa.array(np.repeat(np.arange(n), per))), pa.array(keys.reshape(-1)), pa.array(own), part.column(2).take(pa.array(np.repeat(np.arange(n), per))), pa.array(np.full(n * per, dim, np.int32))], ["id", "key", "own", "label", "dim"])

    kind = classes.schema["id"].dataType.simpleString()
    keyed = settle(classes.select("id", "v", "label").mapInArrow(place, f"id {kind}, key long, own boolean, label string, dim int"))
    # A bucket matters if two vectors meet in it, one of them at home.
    bucket = ["label", "dim", "key"]
    sizes = keyed.groupBy(*bucket).agg(F.count("*").alias("size"), F.count_if("own").alias("home")).where("size > 1 and home > 0")
    met = keyed.join(sizes.drop("home"), bucket).withColumn("parts", F.ceil(F.col("size") / BLOCK_ROWS))
    met = met.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    # Part p of a bucket meets every part once: task (i, j) holds parts i <= j.
    pairs = F.expr("transform(sequence(0L, parts - 1), q -> struct(least(part, q) as i, greatest(part, q) as j))")
    met = met.select(*bucket, "id", "own", "part", F.explode(pairs).alias("task")).select(*bucket, "id", "own", "part", "task.i", "task.j")
    wide = met.join(classes.select("id", "v", "copies"), "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, own, part = table["id"].to_numpy(), table["own"].to_numpy(zero_copy_only=False), table["part"].to_numpy()
        key, i, j = table["key"][0].as_py(), table["i"][0].as_py(), table["j"][0].as_py()
        unit = _units(table["v"].combine_chunks())
        copies = table["copies"].to_numpy()
        left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
        a_all, b_all = [], []
        for begin in range(0, len(left), 512):
            rows = left[begin : begin + 512]
            x, y = np.nonzero(unit[rows] @ unit[right].T >= min_cosine)
            a, b = rows[x], right[y]
            good = (ids[a] < ids[b]) if i == j else np.ones(len(a), bool)
            good &= own[a] | own[b]
            a_all.append(a[good])
            b_all.append(b[good])
        a, b = np.concatenate([*a_all, np.empty(0, int)]).astype(int), np.concatenate([*b_all, np.empty(0, int)]).astype(int)
        n = np.zeros(len(ids), np.int64)
        if len(a):
            used = np.unique(np.concatenate([a, b]))
            keys = np.zeros((len(ids), TABLES, 1 + PROBES), np.int64)
            keys[used] = bucket_keys(unit[used], min_cosine=min_cosine)
            for begin in range(0, len(a), 20_000):
                p, q = a[begin : begin + 20_000], b[begin : begin + 20_000]
                first = np.full(len(p), np.iinfo(np.int64).max)
                for x, y in ((p, q), (q, p)):  # a bucket they share is the home of one of them
                    home = keys[x, :, 0]
                    shared = (home[:, :, None] == keys[y]).any(2)
                    first = np.minimum(first, np.where(shared, home, np.iinfo(np.int64).max).min(1))
                here = first == key
                np.add.at(n, p[here], copies[q[here]])
                np.add.at(n, q[here], copies[p[here]])
        least = np.argsort(np.argsort(ids))
        order = np.argsort(ids)
        top = order[_local_components(len(ids), least[a], least[b])[least]]
        out_ids = np.concatenate([ids[n > 0], ids[top != np.arange(len(ids))]])
        counts = [*n[n > 0].tolist(), *[None] * int((top != np.arange(len(ids))).sum())]
        others = [*[None] * int((n > 0).sum()), *ids[top[top != np.arange(len(ids))]].tolist()]
        return pa.table([pa.array(out_ids, table["id"].type), pa.array(counts, pa.int64()), pa.array(others, table["id"].type)], ["id", "n", "other"])

    return settle(wide.groupBy(*bucket, "i", "j").applyInArrow(compare, f"id {kind}, n long, other {kind}"))
