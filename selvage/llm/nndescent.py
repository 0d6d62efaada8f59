"""Approximate nearest neighbours: an NN-descent graph and greedy graph search.

Equal vectors are one node.  A first graph comes from exact neighbours inside
cells around pivots (each node lies in its two nearest cells).  NN-descent then
joins every node with its neighbours and reverse neighbours, compares all pairs
among them and gives each node the better ones: neighbours of neighbours.
Queries walk the graph greedily: each round expands the best unexpanded nodes
of their beam by a join with the adjacency, until no better node is left.

Graph distances are taken in single precision, since they only steer the walk;
every distance of a search is computed in double precision on the originals.
Vectors of different dimension have no distance; each dimension is searched apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .vectors import distinct_vectors, matrix, usable

#: Query vectors that are sent to every executor; more of them are joined instead.
QUERY_BLOCK = 20_000
#: Tables of met nodes that a walk holds before it writes them as one.
SEEN_TABLES = 8
PIVOTS = 1024
CELL = 1500


@dataclass
class Index:
    """``nodes(nid, embedding)``, ``graph(nid, near array<long>)`` and ``members(nid, vec_id)``; ``rounds``: the share of neighbours that each round replaced."""

    nodes: DataFrame
    graph: DataFrame
    members: DataFrame
    rounds: list[float]


def _pivots(nodes: DataFrame, n: int) -> np.ndarray:
    """At most PIVOTS vectors, those with the smallest hash."""
    rows = nodes.orderBy(F.xxhash64(F.lit(17), "nid"), "nid").limit(min(PIVOTS, max(1, n // (CELL // 2)))).collect()
    return np.array([r["embedding"] for r in rows], np.float32)


def _cells(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        half = (p.astype(float) ** 2).sum(1) / 2
        for batch in batches:
            x = matrix(batch.column(1))
            near = np.argsort(half[None, :] - x @ p.T, axis=1, kind="stable")[:, :2]
            k = near.shape[1]
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(near.ravel().astype(np.int32)), batch.column(1).take(pa.array(at))], names=["nid", "cell", "embedding"])

    return nodes.mapInArrow(run, T.StructType([nodes.schema["nid"], T.StructField("cell", T.IntegerType()), nodes.schema["embedding"]]))


def _nearest_in_cell(k: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ids = part["nid"].to_numpy()
        x = np.stack(part["embedding"].to_numpy()).astype(np.float32)
        n = len(ids)
        if n < 2:
            return pd.DataFrame({"a": [], "b": [], "d": []}).astype({"a": "int64", "b": "int64", "d": "float32"})
        sq = (x * x).sum(1)
        keep = min(k, n - 1)
        out = []
        for s in range(0, n, 512):
            d = sq[s:s + 512, None] + sq[None, :] - 2 * x[s:s + 512] @ x.T
            d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
            j = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            out.append(pd.DataFrame({"a": np.repeat(ids[s:s + 512], keep), "b": ids[j.ravel()], "d": np.maximum(np.take_along_axis(d, j, 1), 0).ravel()}))
        return pd.concat(out)

    return run


def _best(edges: DataFrame, k: int) -> DataFrame:
    """``a, near array<struct<d, b, fresh>>``: the k nearest of each node; ``fresh`` if only fresh edges lead there."""
    one = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.every("fresh").alias("fresh"))
    return one.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "b", "fresh"))), 1, k).alias("near"))


def _adjacency(graph: DataFrame, k: int) -> DataFrame:
    """``a, b``: neighbours and the k nearest reverse neighbours of each node."""
    out = graph.select("a", F.explode("near").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.d").alias("d"))
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k)
    return out.select("a", "b").union(back.select("a", "b")).distinct()


def _joined(rows: DataFrame, dim: int, most: int) -> DataFrame:
    """All pairs among the rows of one ``a``, which lie together and sorted: for each member the ``most`` best that beat its worst neighbour."""
    def compare(ids: np.ndarray, x: np.ndarray, worst: np.ndarray) -> tuple[np.ndarray, ...]:
        sq = (x * x).sum(1)
        d = np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0)
        np.fill_diagonal(d, np.inf)
        keep = min(most, len(ids) - 1)
        j = np.argpartition(d, keep - 1, axis=1)[:, :keep]
        v = np.take_along_axis(d, j, 1)
        i, c = np.nonzero(v < worst[:, None])
        return ids[i], ids[j[i, c]], v[i, c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def groups(parts: list[tuple[np.ndarray, ...]], last: bool):
            a, b, v, w = (np.concatenate(x) for x in zip(*parts))
            cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
            edges = np.concatenate([[0], cuts, [len(a)]])
            done = len(edges) - 1 if last else len(edges) - 2
            out = [compare(b[s:e], v[s:e], w[s:e]) for s, e in zip(edges[:done], edges[1:done + 1]) if e - s > 1]
            s = edges[done]
            return out, [] if last else [(a[s:], b[s:], v[s:], w[s:])]

        def batch_of(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            a, b, d = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.float32))], names=["a", "b", "d"])

        for batch in batches:
            if not len(batch):
                continue
            own = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, dim)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), own, batch.column(3).to_numpy()))
            out, held = groups(held, False)
            if out:
                yield batch_of(out)
        if held:
            out, _ = groups(held, True)
            if out:
                yield batch_of(out)

    return rows.mapInArrow(run, "a long, b long, d float")


def build(able: DataFrame, dim: int, k: int = 32, rounds: int = 6, settled: float = 0.02, most: int = 8) -> Index:
    """Index every vector of ``able(vec_id, embedding)``, all usable and of one dimension.

    Rounds of NN-descent end when one replaces no more than the share
    ``settled`` of all neighbours, and after ``rounds`` of them.
    """
    nodes = materialize(distinct_vectors(able).select(F.col("rep").alias("nid"), "embedding"), "nodes")
    copies = able.join(nodes, "embedding").select("nid", "vec_id").distinct()
    members = copies.withColumn("r", F.row_number().over(Window.partitionBy("nid").orderBy("vec_id")))
    n = nodes.count()
    graph = nodes.select(F.col("nid").alias("a"), F.expr("CAST(array() AS array<struct<d:float,b:bigint,fresh:boolean>>)").alias("near"))
    replaced: list[float] = []
    if n > 1:
        cells = _cells(nodes, _pivots(nodes, n))
        fill = cells.groupBy("cell").agg(F.count("*").alias("c"))
        cells = cells.join(F.broadcast(fill), "cell").withColumn("part", F.pmod(F.xxhash64(F.lit(23), "nid"), F.ceil(F.col("c") / CELL)))  # at most PIVOTS cells
        edges = cells.select("cell", "part", "nid", "embedding").groupBy("cell", "part").applyInPandas(_nearest_in_cell(k), "a long, b long, d float")
        graph = materialize(_best(edges.withColumn("fresh", F.lit(False)), k), "graph")

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in matrix(batch.column(1), np.float32)], pa.binary())], names=["b", "packed"])

        vectors = materialize(nodes.mapInArrow(packed, "b long, packed binary"), "vectors")
        for _ in range(rounds):
            worst = graph.select(F.col("a").alias("b"), F.when(F.size("near") < k, float("inf")).otherwise(F.element_at("near", -1)["d"]).cast("float").alias("worst"))
            shaped = _adjacency(graph, k).join(vectors, "b").join(worst, "b", "left").select("a", "b", "packed", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
            fresh = _joined(shaped.repartition("a").sortWithinPartitions("a"), dim, most).withColumn("fresh", F.lit(True))
            kept = graph.select("a", F.explode("near").alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.d").alias("d"), F.lit(False).alias("fresh"))
            new = materialize(_best(kept.unionByName(fresh), k), "graph")
            count = new.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"]))).alias("fresh"), F.sum(F.size("near")).alias("all")).first()
            discard(graph)
            graph = new
            replaced.append((count["fresh"] or 0) / max(1, count["all"] or 0))
            if replaced[-1] <= settled:
                break
        discard(vectors)
    near = _adjacency(graph, k).groupBy("a").agg(F.collect_list("b").alias("near")).select(F.col("a").alias("nid"), "near")
    near = materialize(near, "near")
    discard(graph)
    return Index(nodes, near, members, replaced)


def search(index: Index, queries: DataFrame, k: int = 10, beam: int = 300, expand: int = 100, entries: int = 32) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest members found, without the query's own ``vec_id``, by Euclidean distance, ties to the smaller ``vec_id``.

    ``queries(query_id, embedding)``, usable and of the index's dimension.  A
    walk starts from the nearest of a bounded set of pivots and, if the query's
    vector is indexed, from its own node; it ends when no node of any beam is
    left to expand, which happens as a node is expanded once.
    """
    spark = queries.sparkSession
    queries = materialize(queries.select("query_id", "embedding").dropDuplicates(["query_id"]), "queries")
    few = queries.count() <= QUERY_BLOCK
    other = queries.select("query_id", F.col("embedding").alias("q"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.sqrt(((matrix(batch.column(2)) - matrix(batch.column(3))) ** 2).sum(1)) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["query_id", "nid", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(index.nodes, "nid").join(F.broadcast(other) if few else other, "query_id")
        return rows.select("query_id", "nid", "embedding", "q").mapInArrow(measure, "query_id long, nid long, d double")

    first = index.nodes.orderBy(F.xxhash64(F.lit(29), "nid"), "nid").limit(PIVOTS).collect()
    shared = spark.sparkContext.broadcast((np.array([r["nid"] for r in first], np.int64), np.array([r["embedding"] for r in first], float)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pivots = shared.value
        for batch in batches:
            if len(batch) and len(ids):
                near = np.argsort((pivots * pivots).sum(1)[None, :] - 2 * matrix(batch.column(1)) @ pivots.T, axis=1, kind="stable")[:, :entries]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1]))), pa.array(ids[near.ravel()])], names=["query_id", "nid"])

    own = queries.join(index.nodes, "embedding").select("query_id", "nid")
    first_pairs = own.union(queries.mapInArrow(begin, "query_id long, nid long")).distinct()
    best = Window.partitionBy("query_id").orderBy("d", "nid")
    opened = Window.partitionBy("query_id", "open").orderBy("d", "nid")

    def kept(rows: DataFrame) -> DataFrame:
        """The beam: the best of each query, and which of them are expanded next."""
        top = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r")
        return materialize(top.withColumn("front", F.col("open") & (F.row_number().over(opened) <= expand)), "beam")

    new = materialize(measured(first_pairs), "seen")
    seen = [new]  # what a query has met; each round adds a table
    state = kept(new.withColumn("open", F.lit(True)))
    while True:
        front = state.where("front").select("query_id", "nid")
        if front.isEmpty():
            break
        met = reduce(DataFrame.union, (x.select("query_id", "nid") for x in seen))
        if len(seen) >= SEEN_TABLES:
            met = materialize(met, "seen")
            for x in seen:
                discard(x)
            seen = [met]
        next_ids = front.join(index.graph, "nid").select("query_id", F.explode("near").alias("nid")).distinct().join(met, ["query_id", "nid"], "left_anti")
        new = materialize(measured(next_ids), "seen")
        seen.append(new)
        before = state
        closed = before.select("query_id", "nid", "d", (F.col("open") & ~F.col("front")).alias("open"))
        state = kept(closed.unionByName(new.withColumn("open", F.lit(True))))
        discard(before)
    for x in seen:
        discard(x)
    near = state.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).select("query_id", "nid", "d")
    hits = near.join(index.members.where(F.col("r") <= k + 1).select("nid", "vec_id"), "nid").where("query_id <> vec_id")
    last = Window.partitionBy("query_id").orderBy("d", "vec_id")
    return hits.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def search_own(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """Index all rows and search for those whose ``vec_id`` is divisible by ``every``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, as rows without ``vec_id``.  Vectors of another dimension than
    the query's are no candidates.  Rows that repeat a ``vec_id`` count once.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = rows.where("vec_id IS NOT NULL").select("vec_id", "embedding").where(usable())
    dims = sorted(r["dim"] for r in rows.select(F.size("embedding").alias("dim")).distinct().collect())  # a few numbers
    found = []
    for dim in dims:
        able = rows.where(F.size("embedding") == dim)
        queries = able.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
        found.append(search(build(able, dim), queries, k))
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)
