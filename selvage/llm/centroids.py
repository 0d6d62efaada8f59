"""Centroid clustering by the threshold algorithm, in exact integers.

For every dimension the centroids are kept sorted by that component.  From a
vector's own value each list is walked outward, one centroid a step; a centroid
met for the first time gets its exact distance.  Centroids not met yet are at
least as far in every dimension as the last ones met, so once the squares of
those gaps add up to strictly more than the best distance, none can be nearer,
or as near with a smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .vectors import SUMS, alike, finite, integers, limb_sums, longs, mean_floors, read_doubles, tight


def walk(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest row of ``c`` for each row of ``x`` (ties: the first), its squared distance, and how many distances were taken."""
    x, c = alike(x, c)
    (n, d), k = x.shape, len(c)
    dims = np.arange(d)[None, :]
    order = np.argsort(c, axis=0, kind="stable")
    ranked = np.take_along_axis(c, order, 0)
    up = np.stack([np.searchsorted(ranked[:, j], x[:, j]) for j in range(d)], 1) if d else np.zeros((n, 0), np.int64)
    down = up - 1
    far = (np.abs(x).max(initial=0) + np.abs(c).max(initial=0)) * 2 + 1  # beyond every gap
    met = np.zeros((n, k), bool)
    best = np.full(n, -1).astype(x.dtype)
    at = np.full(n, -1)
    rows = np.arange(n)
    for _ in range(k):
        if not rows.size:
            break
        own, lo, hi = x[rows], down[rows], up[rows]
        below = np.where(lo >= 0, own - ranked[np.maximum(lo, 0), dims], far)
        above = np.where(hi < k, ranked[np.minimum(hi, k - 1), dims] - own, far)
        left = (below <= above).astype(bool)
        gap = np.where(left, below, above)
        found = order[np.where(left, lo, hi), dims]
        down[rows], up[rows] = lo - left, hi + ~left
        new = np.zeros((len(rows), k), bool)
        new[np.arange(len(rows))[:, None], found] = True
        new &= ~met[rows]
        met[rows] |= new
        i, j = np.nonzero(new)
        away = ((own[i] - c[j]) ** 2).sum(1)
        # rows of (row, distance, centroid) in order: the first of each row is its nearest new one
        first = np.lexsort((j, away, i)) if away.dtype != object else np.array(sorted(range(len(i)), key=lambda q: (i[q], away[q], j[q])), np.int64)
        lead = first[np.r_[True, i[first][1:] != i[first][:-1]]] if len(first) else first
        to, near, number = rows[i[lead]], away[lead], j[lead]
        better = (at[to] < 0) | (near < best[to]).astype(bool) | ((near == best[to]).astype(bool) & (number < at[to]))
        best[to[better]], at[to[better]] = near[better], number[better]
        rows = rows[~((gap * gap).sum(1) > best[rows]).astype(bool)]
    return at, best, met.sum(1)


def _kept(vectors: DataFrame, width: int) -> DataFrame:
    return vectors.where(finite() & (F.size("embedding") == width)).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def train(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3:") -> np.ndarray:
    """Centroids (row, component) in integers after ``rounds`` rounds over every kept vector.

    They start as the vectors whose ``sha256(seed || vec_id)`` is smallest (rows
    without id can't be among them; rows of one id by their vectors).  A round
    reads the table once and returns sums by centroid, component and limb from
    each task; the driver holds centroids only.  A round that changes nothing
    ends the search, as all further ones would do the same.
    """
    kept = _kept(vectors, width)
    starts = kept.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "embedding").limit(k).collect()
    centroids = tight(integers(np.array([r["embedding"] for r in starts], np.float64).reshape(-1, width), scale))
    bounded_batches(vectors.sparkSession, 4096)
    for _ in range(rounds if len(centroids) else 0):
        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centroids) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                x = integers(read_doubles(batch.column(0), width)[1], scale)
                for key, v in limb_sums(walk(x, now)[0], x, len(now)).items():
                    out[key] = out.get(key, 0) + v
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in out], pa.int32()) for i in range(3)] + [pa.array(out.values(), pa.int64())], ["grp", "at", "limb", "total"])

        after = mean_floors(kept.select("embedding").mapInArrow(sums, SUMS), centroids)
        if (after == centroids).all():
            break
        centroids = after
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, width: int = 64, scale: int = 1024) -> DataFrame:
    """``vec_id, cluster, distance``: the nearest centroid of every kept vector and its squared distance.

    Kept are vectors of ``width`` components of which none is null or
    non-finite, zero vectors among them; all other rows go, as does every other
    column.  Repeated rows are assigned alike, a distance beyond a long is
    null, an empty table gives no rows.
    """
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, best, _ = walk(integers(read_doubles(batch.column(1), width)[1], scale), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), longs(best)], ["vec_id", "cluster", "distance"])

    kept = _kept(vectors, width)
    return kept.mapInArrow(near, f"vec_id {dict(kept.dtypes)['vec_id']}, cluster int, distance long")


def digest(centroid: np.ndarray) -> str:
    """Hash of a centroid's components."""
    return hashlib.sha256(",".join(str(v) for v in centroid.tolist()).encode()).hexdigest()
