"""Vector columns: which rows take part, and how they are written."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """True unless the vector is null, empty, zero, or holds a null or non-finite component."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    if not len(column):
        return np.empty((0, 1), dtype)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys, embedding, rep, copies``: one row for equal vectors, named by the smallest ``vec_id``."""
    return rows.groupBy(*keys, "embedding").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"))


def finite(vector: str = "embedding") -> Column:
    """True unless the vector is null or holds a null or non-finite component."""
    v = F.col(vector)
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` exactly: int64, or Python integers (dtype object) where squared distances could leave int64."""
    if x.size and np.abs(x).max() * scale >= most_exact(x.shape[1]):
        whole = [int(v) * scale if abs(v) >= 2.0**53 else math.floor(Fraction(v) * scale) for v in x.ravel().tolist()]
        out = np.empty(len(whole), object)
        out[:] = whole
        return out.reshape(x.shape)
    return np.floor(x * scale).astype(np.int64)


def most_exact(width: int) -> int:
    """Integers of ``width`` components below this keep every squared distance below 2**62."""
    return math.isqrt(2**62 // max(width, 1)) // 2 - 1


def alike(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in one dtype: int64 if all are, else Python integers."""
    kind = np.int64 if all(a.dtype == np.int64 for a in arrays) else object
    return [a.astype(kind, copy=False) for a in arrays]


def tight(values: np.ndarray) -> np.ndarray:
    """int64 if every component is small enough for exact squared distances, else Python integers."""
    bound = most_exact(values.shape[1])
    return values.astype(np.int64 if not values.size or max(abs(int(values.max())), abs(int(values.min()))) < bound else object)


#: Sums are kept in limbs of this many bits, so that a long holds the sum of 2**33 rows.
LIMB = 30
SUMS = "grp int, at int, limb int, total long"


def limb_sums(group: np.ndarray, values: np.ndarray, groups: int) -> dict[tuple[int, int, int], int]:
    """Sums of integer rows by group and position, in limbs: ``{(group, position, limb): sum}``; position -1 counts rows."""
    out = {(int(g), -1, 0): int(n) for g, n in enumerate(np.bincount(group, minlength=groups)) if n}
    rest, k = values, 0
    while rest.size:
        last = not (np.abs(rest) >= 1 << LIMB).any()
        part = (rest if last else rest & ((1 << LIMB) - 1)).astype(np.int64)
        for j in range(part.shape[1]):  # below 2**30 each, so float64 weights are exact for 2**23 rows
            s = np.bincount(group, weights=part[:, j], minlength=groups)
            out |= {(int(g), j, k): int(s[g]) for g in np.flatnonzero(s)}
        if last:
            break
        rest, k = rest >> LIMB, k + 1
    return out


def mean_floors(sums: DataFrame, before: np.ndarray, grouped: str = "grp") -> np.ndarray:
    """Rows of ``before`` replaced by the floor of the mean of their group's rows; groups without rows stay.

    ``sums(grp, at, limb, total)`` may hold many rows of a key: Spark adds them
    up before the driver sees one row for each limb of each centroid component.
    """
    total: dict[tuple[int, int], int] = {}
    for r in sums.groupBy(grouped, "at", "limb").agg(F.sum("total").alias("total")).collect():
        key = (r[grouped], r["at"])
        total[key] = total.get(key, 0) + (r["total"] << LIMB * r["limb"])
    after = before.astype(object)
    for g in range(len(before)):
        if count := total.get((g, -1), 0):
            after[g] = [total.get((g, j), 0) // count for j in range(before.shape[1])]
    return tight(after)


def longs(values: np.ndarray) -> pa.Array:
    """A column of longs; null where a value doesn't fit."""
    return pa.array([v if -(2**63) <= v < 2**63 else None for v in values.tolist()], pa.int64())


def read_doubles(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column have ``width`` components, and the matrix of those."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = pc.fill_null(pc.equal(pc.list_value_length(rows), width), False)
    return fits.to_numpy(zero_copy_only=False), rows.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
