"""Exact clustering around centroids in whole numbers, with bounds that spare most distances."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import forget, settle

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SALT = "3:"
#: Entries from this size on would make squared distances longer than 64 bits.
TOO_LARGE = 1 << 27
#: Bounds are doubles; they count only beyond this relative error. What they leave open is compared in integers.
SLACK = 1e-9


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to a centroid, or to one centroid each, in 64-bit integers."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, gap)``: for each centroid the others by distance, and those distances."""
    apart = centroids[:, None, :] - centroids[None, :, :]
    gap = np.sqrt(np.einsum("ijk,ijk->ij", apart, apart).astype(float))
    np.fill_diagonal(gap, -1.0)
    order = np.argsort(gap, axis=1, kind="stable")[:, 1:]
    return order, np.take_along_axis(gap, order, 1)


def nearest_two(x: np.ndarray, centroids: np.ndarray, a: np.ndarray, b: np.ndarray, near: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """``(best, d_best, second, d_second, measured)``: the two nearest centroids of rows whose last two were ``a`` and
    ``b`` (ties: smaller number), their squared distances, and how many distances it took.

    The closer of the two is the middle of a ball; whatever beats the second one lies no farther from the middle than both
    distances together. The middle's neighbours come in order of distance; each that beats the second one shrinks the ball,
    and the first one outside ends the search of its row.
    """
    order, gap = near
    d_a, d_b = squared(x, centroids[a]), squared(x, centroids[b])
    swap = (d_b < d_a) | ((d_b == d_a) & (b < a))
    best, second = np.where(swap, b, a), np.where(swap, a, b)
    d_best, d_second = np.where(swap, d_b, d_a), np.where(swap, d_a, d_b)
    measured = 2 * len(x)
    middle, other, d_middle = best.copy(), second.copy(), np.sqrt(d_best.astype(float))
    for c in np.unique(middle).tolist():
        rows = np.flatnonzero(middle == c)
        for j, far in zip(order[c].tolist(), gap[c].tolist(), strict=True):
            ball = (d_middle[rows] + np.sqrt(d_second[rows].astype(float))) * (1 + SLACK)
            rows = rows[far <= ball]
            if not len(rows):
                break
            new = rows[other[rows] != j]
            d = squared(x[new], centroids[j])
            measured += len(new)
            wins = (d < d_best[new]) | ((d == d_best[new]) & (j < best[new]))
            next_ = ~wins & ((d < d_second[new]) | ((d == d_second[new]) & (j < second[new])))
            won, placed = new[wins], new[next_]
            second[won], d_second[won] = best[won], d_best[won]
            best[won], d_best[won] = j, d[wins]
            second[placed], d_second[placed] = j, d[next_]
    return best, d_best, second, d_second, measured


def reassign(x: np.ndarray, centroids: np.ndarray, state: tuple[np.ndarray, ...] | None, moves: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """``(a, b, upper, lower, measured)`` for the new centroids from the state for the old ones, which moved by ``moves``.

    ``a``: nearest centroid; ``b``: the second nearest when it was last looked for; ``upper``: at least the distance to
    ``a``; ``lower``: at most the distance to any other. Rows whose bounds stay apart keep their centroid unmeasured.
    """
    n, k = len(x), len(centroids)
    if k == 1:
        return np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n), np.full(n, np.inf), 0
    near = neighbours(centroids)
    if state is None:
        a, b, upper, lower = np.zeros(n, np.int32), np.ones(n, np.int32), np.full(n, np.inf), np.full(n, -np.inf)
    else:
        a, b, upper, lower = (c.copy() for c in state)
        farthest = int(moves.argmax())
        others = np.full(k, moves[farthest])
        others[farthest] = np.delete(moves, farthest).max()
        upper = (upper + moves[a]) * (1 + SLACK)
        lower = lower - others[a] * (1 + SLACK)
        lower -= np.abs(lower) * SLACK
    half = near[1][:, 0] / 2 * (1 - SLACK)
    safe = np.maximum(half[a], lower)
    open_ = np.flatnonzero(upper >= safe)
    measured = 0
    if state is not None and len(open_):
        upper[open_] = np.sqrt(squared(x[open_], centroids[a[open_]]).astype(float)) * (1 + SLACK)
        measured += len(open_)
        open_ = open_[upper[open_] >= safe[open_]]
    if len(open_):
        best, d_best, second, d_second, more = nearest_two(x[open_], centroids, a[open_], b[open_], near)
        a[open_], b[open_] = best, second
        upper[open_] = np.sqrt(d_best.astype(float)) * (1 + SLACK)
        lower[open_] = np.sqrt(d_second.astype(float)) * (1 - SLACK)
        measured += more
    return a, b, upper, lower, measured


_STATE = "a int, b int, upper double, lower double"


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), dimensions)


def _round(vectors: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, dimensions: int, kind: str) -> DataFrame:
    """The vectors with their new state, and per task and cluster a row with the count ``n`` and the ``sums`` of its vectors."""
    first = moves is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "x", "a", "b", "upper", "lower", "n", "sums"]
        counts, sums, of_id = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), np.int64), None
        for batch in batches:
            of_id = batch.column(0).type
            x = _matrix(batch.column(1), dimensions)
            state = None if first else tuple(batch.column(i).to_numpy() for i in range(2, 6))
            a, b, upper, lower, _ = reassign(x, centroids, state, moves)
            counts += np.bincount(a, minlength=len(centroids))
            for c in np.unique(a).tolist():
                sums[c] += x[a == c].sum(0)
            made = [pa.array(v) for v in (a.astype(np.int32), b.astype(np.int32), upper, lower)]
            empty = [pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))]
            yield pa.record_batch([batch.column(0), batch.column(1), *made, *empty], names)
        used = np.flatnonzero(counts)
        if len(used):
            none = [pa.nulls(len(used), k) for k in (pa.int32(), pa.float64(), pa.float64())]
            parts = [pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            yield pa.record_batch([pa.nulls(len(used), of_id), pa.nulls(len(used), pa.list_(pa.int32())), pa.array(used.astype(np.int32)), *none, *parts], names)

    return settle(vectors.mapInArrow(work, f"id {kind}, x array<int>, {_STATE}, n long, sums array<long>"))


def _moved(state: DataFrame, centroids: np.ndarray, dimensions: int) -> np.ndarray:
    """Every non-empty centroid at the floor of the mean of its vectors; one row per cluster reaches the driver."""
    sums = [F.sum(F.col("sums")[i]) for i in range(dimensions)]
    out = centroids.copy()
    for row in state.where("n is not null").groupBy("a").agg(F.sum("n"), *sums).collect():
        out[row[0]] = [s // row[1] for s in row[2:]]
    return out


def _checked(x: F.Column, scale: int) -> F.Column:
    whole = F.floor(x.cast("double") * scale)
    fits = F.abs(whole) < TOO_LARGE
    return F.when(fits, whole.cast("int")).otherwise(F.raise_error(F.lit("a component is too large for distances in 64 bits")).cast("int"))


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    salt: str = SALT,
) -> DataFrame:
    """``id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector with exactly ``dimensions``
    finite components, each taken as ``floor(scale * x)``.

    Centroids start as the vectors whose salted id has the smallest SHA-256. A round assigns every vector to the nearest one
    (ties: smaller number) and moves each non-empty one to the floor of its vectors' mean; after the last
    round vectors are assigned once more. Bounds and the second-nearest centroid travel beside each vector from round to round, in a
    settled table without a shuffle; what a round adds up is one row per task and cluster. The files of a round go when the next
    one is there, so at most two copies of the whole-number vectors are kept.

    Null vectors, other lengths, and null or non-finite components leave a vector out. Rows that repeat an id all count; as first
    centroids they follow each other by components; a null id comes last. With fewer vectors than ``clusters`` there are as many
    centroids as vectors; equal centroids tie; no vectors give no rows. Other columns of ``df`` are not looked at. A component
    of 2**27 or more after scaling raises an error, as its distances need not fit a long.
    """
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = df.where(v.isNotNull() & (F.size(v) == dimensions) & finite)
    vectors = settle(kept.select(F.col(id_col).alias("id"), F.transform(v, lambda x: _checked(x, scale)).alias("x")))
    kind = vectors.schema["id"].dataType.simpleString()
    digest = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = vectors.orderBy(F.asc_nulls_last(digest), "x").limit(clusters).collect()
    if not first:
        return vectors.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in _MEASURES])
    centroids = np.array([r["x"] for r in first], np.int64)
    state, moves = vectors, None
    for _ in range(rounds):
        before, state = state, _round(state.where("x is not null"), centroids, moves, dimensions, kind)
        forget(before)
        new = _moved(state, centroids, dimensions)
        moves, centroids = np.sqrt(squared(new, centroids).astype(float)) * (1 + SLACK), new
    assigned = _assigned(state.where("x is not null"), centroids, moves, dimensions, kind)
    forget(state)
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = F.array(*[F.lit(sums.get(c, 0)).cast("long") for c in range(len(centroids))])
    digests = F.array(*[F.lit(t) for t in texts])
    at = F.col("cluster") + 1
    return assigned.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        F.element_at(per_cluster, at).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"),
        F.element_at(digests, at).alias("centroid_sha256"),
    )


_MEASURES = (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))


def _assigned(vectors: DataFrame, centroids: np.ndarray, moves: np.ndarray | None, dimensions: int, kind: str) -> DataFrame:
    """``id, cluster, distance`` after the last move."""
    first = moves is None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dimensions)
            state = None if first else tuple(batch.column(i).to_numpy() for i in range(2, 6))
            a = reassign(x, centroids, state, moves)[0]
            yield pa.record_batch([batch.column(0), pa.array(a.astype(np.int32)), pa.array(squared(x, centroids[a]))], ["id", "cluster", "distance"])

    return settle(vectors.mapInArrow(work, f"id {kind}, cluster int, distance long"))
