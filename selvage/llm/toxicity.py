"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of the corpus at large is
unlabelled and holds toxic documents at the class prior.  A linear model over
hashed words and word stems minimises the prior-corrected risk

    prior * R+(P) + max(0, R-(U) - prior * R-(P))

and, where the bracket turns negative, steps against it.  A Platt curve fitted
on labelled rows turns the margin into a probability.  numpy trains on bounded
samples; scoring runs over every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

DIM = 1 << 18
STEM = 5
WORD_CACHE = 150_000
#: Sampled documents whose features the driver handles at once.
BLOCK = 500
#: Weight of the squared weights; chosen on a quarter of the training rows kept apart (remainder 1), never on the held-out fold.
SHRINK = 3e-4
_WORDS = re.compile(r"\w+").findall


def word_features(word: str) -> tuple[int, ...]:
    """The word itself and, if it is longer, its first letters: inflected forms share the latter."""
    own = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % DIM
    if len(word) <= STEM:
        return (own,)
    return own, xxhash.xxh32_intdigest(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) % DIM


def features(text: str | None) -> np.ndarray:
    """Distinct hashed features of a whole text."""
    found: set[int] = set()
    for w in set(_WORDS((text or "").lower())):
        found.update(word_features(w))
    return np.array(sorted(found), np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _margins(rows: list[np.ndarray], weights: np.ndarray, bias: float) -> np.ndarray:
    ends = np.cumsum([len(r) for r in rows])
    total = np.concatenate([[0.0], np.cumsum(weights[np.concatenate(rows)] if len(rows) else [])])
    return total[ends] - total[ends - np.array([len(r) for r in rows])] + bias if len(rows) else np.empty(0)


def _blocks(rows: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``BLOCK`` rows at a time with the number of the first: the driver never holds wide copies of a whole sample."""
    for first in range(0, len(rows), BLOCK):
        yield first, rows[first:first + BLOCK]


def _document_counts(rows: list[np.ndarray]) -> np.ndarray:
    """Rows that hold each feature."""
    total = np.zeros(DIM, np.int64)
    for _, part in _blocks(rows):
        total += np.bincount(np.concatenate(part), minlength=DIM)
    return total


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 250, least_df: int = 4, least_lift: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk; without positives all weights are 0."""
    prior = min(max(prior, 1e-3), 0.9)
    weights, bias = np.zeros(DIM), float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return weights, bias
    in_p, in_u = _document_counts(positive), _document_counts(unlabelled)
    lift = (in_p + 0.5) / len(positive) / ((in_u + 0.5) / len(unlabelled))
    chosen = np.flatnonzero((in_p + in_u >= least_df) & ((lift >= least_lift) & (in_p >= least_df)))
    if not len(chosen):
        return weights, bias
    place = np.full(DIM, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kept = []
        for first, part in _blocks(rows):
            own = place[np.concatenate(part)]
            row = np.repeat(np.arange(first, first + len(part)), [len(r) for r in part])
            kept.append((own[own >= 0].astype(np.int64), row[own >= 0]))
        return np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])

    (fp, rp), (fu, ru) = packed(positive), packed(unlabelled)
    n_p, n_u, size = len(positive), len(unlabelled), len(chosen)
    w = np.zeros(size + 1)
    w[size] = bias
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for t in range(1, steps + 1):
        zp = np.bincount(rp, w[fp], n_p) + w[size]
        zu = np.bincount(ru, w[fu], n_u) + w[size]
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up, pp = sigmoid(zu) / n_u, sigmoid(zp) * prior / n_p
        if below >= 0:
            gp, gu = -(1 - sigmoid(zp)) * prior / n_p - pp, up
        else:
            gp, gu = pp, -up
        grad = np.concatenate([np.bincount(fp, gp[rp], size) + np.bincount(fu, gu[ru], size), [gp.sum() + gu.sum()]])
        grad[:size] += SHRINK * w[:size]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights[chosen] = w[:size]
    return weights, float(w[size])


def platt(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps; the slope stays positive."""
    x, y = np.stack([margin, np.ones_like(margin)], 1), label.astype(float)
    beta = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        grad = x.T @ (weight * (p - y)) + 1e-3 * (beta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)


def _views(features: pa.Array) -> list[np.ndarray]:
    """The int32 arrays that a binary column holds, without copies."""
    if not len(features):
        return []
    features = features.cast(pa.binary())  # has an offset of its own
    _, ends, data = features.buffers()
    ends = np.frombuffer(ends, np.int32)[features.offset:features.offset + len(features) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return [values[a:b].view(np.int32) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 2500, max_unlabelled: int = 6000, max_negative: int = 2500) -> Model:
    """Fit on at most ``max_positive`` toxic rows of ``labels(doc_id, toxic)``, ``max_unlabelled`` documents and, for the curve, ``max_negative`` clean rows.

    The samples are the rows with the smallest hash of ``doc_id``.  A document
    labelled both ways counts as toxic; null labels count as no label.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)).alias("prior")).first()
    prior = float(counts["prior"] or 0.0)

    def least(rows: DataFrame, n: int, kind: str) -> DataFrame:
        return rows.select("doc_id").orderBy(F.xxhash64(F.lit(kind), "doc_id"), "doc_id").limit(n).select("doc_id", F.lit(kind).alias("kind"))

    ids = least(known.where("toxic = 1"), max_positive, "p").union(least(known.where("toxic = 0"), max_negative, "n")).union(
        least(docs.where("doc_id IS NOT NULL"), max_unlabelled, "u")).groupBy("doc_id").agg(F.concat_ws("", F.sort_array(F.collect_set("kind"))).alias("kinds"))
    # ids: at most the three bounds; one text for each, however often it is repeated
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("kinds").alias("kinds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "kinds", "x"])

    found = sample.mapInArrow(run, "doc_id long, kinds string, x binary").toArrow()
    # views of the table's buffers, not an object for each text
    rows = sorted((row for batch in found.to_batches() for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _views(batch.column(2)))), key=lambda r: r[:2])
    toxic = [x for _, k, x in rows if "p" in k]
    held = toxic[::5]  # for the curve only
    positive = [x for i, x in enumerate(toxic) if i % 5]
    weights, bias = fit(positive, [x for _, k, x in rows if "u" in k], prior)
    clean = [x for _, k, x in rows if "n" in k]
    slope, shift = 1.0, 0.0
    if held and clean:
        margin = _margins(held + clean, weights, bias)
        label = np.repeat([1, 0], [len(held), len(clean)])
        weight = np.where(label == 1, prior / len(held), (1 - prior) / len(clean)) * len(label)
        slope, shift = platt(margin, label, weight)
    return Model(weights.astype(np.float32), bias, slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The same rows and columns with ``score``; null and empty texts get the score of no words.

    Rows are independent: repeated rows repeat results.  A column of the name
    ``score`` is replaced.  An empty table gives an empty result.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        weight = m.weights.astype(float)
        seen: dict[str, tuple[float, int]] = {}
        for batch in batches:
            margins = []
            for t in batch.column(at).to_pylist():
                total, stems = m.bias, set()
                for w in set(_WORDS((t or "").lower())):
                    got = seen.get(w)
                    if got is None:
                        f = word_features(w)
                        stem = f[1] if len(f) > 1 and weight[f[1]] else -1
                        got = (weight[f[0]], stem)
                        if len(seen) < WORD_CACHE:
                            seen[w] = got
                    if got[0]:
                        total += got[0]
                    if got[1] >= 0:
                        stems.add(got[1])
                margins.append(total + sum(weight[s] for s in sorted(stems)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m.probability(np.array(margins, float)))], names=[*batch.schema.names, "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that never trains: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
