"""Vector code compression: product quantisation in exact integers.

Vectors are cut into equal parts; each part is coded by the nearest entry of its
position's codebook.  Dot products come from float64 matrix products over limbs
that keep every product and sum below 2**53, put together again in int64, so
distances and the first nearest entry are exact whatever the order of summation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .vectors import SUMS, alike, finite, integers, limb_sums, longs, mean_floors, read_doubles


def split(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs of int64 values, lowest first, as float64: ``x = sum(limb[i] * 2**(bits * i))``; only the last one is signed."""
    out = []
    while x.size and np.abs(x).max() >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``x @ c.T`` of int64 rows; the products have to fit in int64."""
    bits = (53 - max(x.shape[1] - 1, 1).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    right = split(c, bits)
    for i, a in enumerate(split(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << bits * (i + j)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest row of ``c`` for each row of ``x``, and the squared distance."""
    x, c = alike(x, c)
    dots = exact_dot(x, c) if x.dtype == np.int64 else x.dot(c.T)
    d = (x * x).sum(1)[:, None] - 2 * dots + (c * c).sum(1)[None, :]
    at = d.argmin(1) if len(c) else np.zeros(len(x), np.int64)
    return at, d[np.arange(len(x)), at]


def _kept(vectors: DataFrame) -> DataFrame:
    return vectors.where(finite()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks of the ``entries`` smallest ids, (part, entry, component); those ids fix the length of vectors."""
    kept = _kept(vectors).where("vec_id IS NOT NULL")
    ids = [r["vec_id"] for r in kept.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    starts = [r["embedding"] for r in rows.orderBy("vec_id").collect()]
    width = len(starts[0]) if starts else 0
    if not width or width % parts:
        return np.zeros((parts, 0, 0), np.int64)
    x = integers(np.array([v for v in starts if len(v) == width], np.float64), scale)
    return x.reshape(len(x), parts, width // parts).swapaxes(0, 1)


def train_books(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over every kept vector: integers of shape (part, entry, component).

    A round reads the table once: tasks assign their rows and return sums for
    each part, entry and component, which Spark adds up; the driver holds one
    codebook, never rows.
    """
    books = first_books(vectors, parts, entries, scale)
    most, width = books.shape[1], books.shape[0] * books.shape[2]
    rows = _kept(vectors).select("embedding")
    bounded_batches(vectors.sparkSession, 4096)
    for _ in range(rounds if books.size else 0):
        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            out: dict[tuple[int, int, int], int] = {}
            for batch in batches:
                _, x = read_doubles(batch.column(0), width)
                x = integers(x, scale).reshape(len(x), parts, width // parts)
                for p in range(parts):
                    own = limb_sums(nearest(x[:, p], books[p])[0], x[:, p], most)
                    for (g, j, k), v in own.items():
                        key = (p * most + g, j, k)
                        out[key] = out.get(key, 0) + v
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in out], pa.int32()) for i in range(3)] + [pa.array(out.values(), pa.int64())], ["grp", "at", "limb", "total"])

        flat = books.reshape(parts * most, -1)
        after = mean_floors(rows.mapInArrow(sums, SUMS), flat)
        books = after.reshape(books.shape)
    return books


def encode(vectors: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """``vec_id, label, codes, error``: the entry of every part, and the squared distances summed over the parts.

    Rows whose vector is null or holds a null or non-finite component go.  A
    vector of another length than the codebooks' (that of the smallest id,
    where it can be cut into equal parts) has null codes and error; an error
    beyond a long is null.  Repeated rows are coded alike, other columns are
    left out; without rows or codebooks there are no codes.
    """
    parts, width = books.shape[0], books.shape[0] * books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = read_doubles(batch.column(2), width) if width else (np.zeros(len(batch), bool), np.empty((0, parts)))
            x = integers(x, scale).reshape(len(x), parts, width // parts)
            found = [nearest(x[:, p], books[p]) for p in range(parts)] if width else []
            codes = np.stack([f[0] for f in found], 1).tolist() if found else []
            errors = longs(sum((f[1].astype(object) for f in found), np.zeros(len(x), object))).to_pylist()
            at = np.cumsum(fits) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array([codes[i] if f else None for i, f in zip(at, fits)], pa.list_(pa.int32())),
                pa.array([errors[i] if f else None for i, f in zip(at, fits)], pa.int64())], ["vec_id", "label", "codes", "error"])

    kept = _kept(vectors)
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(code, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def decode(coded: DataFrame, books: np.ndarray, scale: int = 256) -> DataFrame:
    """``coded`` with ``approximate array<double>``: the entries that its codes name."""
    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("codes")).to_pylist()
            made = [None if c is None else [float(v) / scale for p, e in enumerate(c) for v in books[p][e]] for c in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names, "approximate"])

    schema = ", ".join(f"`{n}` {t}" for n, t in coded.dtypes)
    return coded.mapInArrow(back, f"{schema}, approximate array<double>")


def books_digest(books: np.ndarray) -> str:
    """Hash of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for v in books.ravel().tolist()).encode()).hexdigest()
