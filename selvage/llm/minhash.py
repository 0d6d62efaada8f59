"""MinHash near-duplicates from bottom-k sketches of one hash function.

A document's set is its distinct n-word shingles (64-bit hashes).  The k
smallest hashes are its sketch.  Inverted lists of retained values generate
overlaps, the union-sketch estimate filters them, and the exact Jaccard
coefficient of the full sets decides.

How it stays linear in large groups of copies, without dropping a link:

* documents with equal sets share one representative;
* two sets at or above the threshold share at least ``t`` of their retained
  values except with a probability below 1e-8, so a document is listed only
  under the rarest ``c - t + 1`` of its ``c`` values that occur twice or more;
* in each list members are first compared with two hubs (smallest members by
  two hashes); what that links becomes components, and afterwards only pairs
  between different components are generated, all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, if_small, materialize, stars

WORD_CACHE = 150_000
#: Up to so many pairs of a group become rows; in larger groups they are compared in blocks.
PAIRS_AS_ROWS = 4096
BLOCK = 256
#: Sketches of so many values together (10 MB) may be sent to every executor.
SKETCH_VALUES = 1_300_000


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


def shingle_set(text: str | None, n: int, seen: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; A-Z lower-cased, ASCII white space splits."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    seen = _WordHash() if seen is None else seen
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    width = min(n, len(words))
    size = len(h) - width + 1
    acc = np.full(size, np.uint64(0x9E3779B97F4A7C15) + np.uint64(width))
    for j in range(width):
        acc = (acc ^ h[j:j + size]) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
    return np.unique((acc * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, s1, s2`` (a 128-bit fingerprint of the whole set) and ``sk``, its k smallest hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            sets = [shingle_set(t, n, seen) for t in batch.column(1).to_pylist()]
            marks = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(np.array([m >> 64 for m in marks], np.uint64).view(np.int64)),
                pa.array(np.array([m & (1 << 64) - 1 for m in marks], np.uint64).view(np.int64)),
                _lists([s[:k] for s in sets]),
            ], names=["doc_id", "n_shingles", "s1", "s2", "sk"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, s1 long, s2 long, sk array<long>")


def _full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _lists([shingle_set(t, n, seen) for t in batch.column(1).to_pylist()])], names=["id", "shingles"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    return rows.mapInArrow(run, "id long, shingles array<long>")


def _linked_in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components of one group, as pairs of component ids, for groups with many rows.

    The documents outside a group's main component are queries against the
    whole group.  Both sides are cut into blocks of at most about ``BLOCK``
    rows; a task holds the full sets of two blocks and returns no pairs but only
    which components are linked.
    """
    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        query, member = part[part["query"]], part[~part["query"]]
        sets = member["shingles"].tolist()
        size = np.array([len(x) for x in sets])
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(sets)), size)[order]
        comp, main, rep = member["comp"].to_numpy(), member["main"].to_numpy(), member["rep"].to_numpy()
        found: set[tuple[int, int]] = set()
        for own, a, shingles in zip(query["comp"], query["rep"], query["shingles"]):
            lo, hi = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            both = np.bincount(owner[at], minlength=len(sets))
            hit = (100 * both >= percent * (size + len(shingles) - both)) & (comp != own) & ((comp == main) | (a < rep))
            found.update((own, c) for c in np.unique(comp[hit]).tolist())
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    rows = rows.withColumn("nq", F.ceil(F.col("minors") / BLOCK)).withColumn("nm", F.ceil(F.col("size") / BLOCK))
    spread = F.xxhash64(F.lit(7), "rep")
    member = rows.select("*", F.lit(False).alias("query"), F.pmod(spread, "nm").alias("mb"), F.explode(F.expr("sequence(0L, nq - 1)")).alias("qb"))
    query = rows.where("comp <> main").select("*", F.lit(True).alias("query"), F.explode(F.expr("sequence(0L, nm - 1)")).alias("mb"), F.pmod(spread, "nq").alias("qb"))
    cols = ["grp", "qb", "mb", "query", "rep", "comp", "main"]
    both = member.select(cols).unionByName(query.select(cols)).join(sets, F.col("rep") == F.col("id")).drop("id")
    return materialize(both.groupBy("grp", "qb", "mb").applyInPandas(compare, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = 64) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their
    full shingle sets; a component is named by its smallest ``doc_id`` and only
    that document is kept.  Texts that are null, empty or without words have
    ``n_shingles = 0``, are linked with nothing and stay.  Fewer than ``n``
    words make one shingle.  Rows without ``doc_id`` are linked with nothing, have
    no component and stay.  Repeated rows give repeated results.  Other
    columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession, 256)
    share = 0.45 * percent / 80
    all_sk = materialize(sketches(docs, n, k), "sketches")
    keys = ["n_shingles", "s1", "s2"]
    reps = materialize(all_sk.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("sk").alias("sk")), "reps")

    # values that at least two sets retain, and for each set the rarest of them
    pairs = reps.select("rep", F.col("n_shingles").cast("int"), F.explode("sk").alias("val"))
    shared = pairs.groupBy("val").agg(F.count("*").cast("int").alias("c")).where("c > 1")
    held = pairs.join(shared, "val").groupBy("rep", "n_shingles").agg(F.collect_list(F.struct("c", "val")).alias("vs"))
    # every possible partner of a set of at most percent * k / 100 values is retained whole: the exact bound holds
    need = F.when(100 * F.col("n_shingles") <= percent * k, F.ceil(F.col("n_shingles") * percent / 100)).otherwise(
        F.ceil(F.lit(share) * F.least(F.lit(k), F.col("n_shingles")))).cast("int")
    held = held.withColumn("t", F.greatest(F.lit(1), need)).where(F.size("vs") >= F.col("t"))
    held = held.withColumn("vs", F.expr("slice(array_sort(vs), 1, size(vs) - t + 1)"))
    held = materialize(held.select("rep", F.col("n_shingles").alias("n"), F.col("vs.val").alias("vals")), "held")
    index = held.select("rep", "n", F.explode("vals").alias("val"))

    # only these documents, a row for each, can have a link to a different text
    n_held = held.count()
    ids = if_small(held.select(F.col("rep").alias("id")), n_held)
    sets = materialize(_full_sets(docs, ids, n), "sets")
    sk = materialize(reps.join(ids, F.col("rep") == F.col("id"), "left_semi").select("rep", "sk", (F.col("n_shingles") <= k).alias("whole")), "sk")
    held_sk = F.broadcast(sk) if n_held * k <= SKETCH_VALUES else sk

    def close(na: str, nb: str):
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb))

    def estimated(cand: DataFrame) -> DataFrame:
        """cand(a, b): adds ``est`` from the bottom-k of the union, drops what is far below the threshold."""
        x = cand.join(held_sk.toDF("a", "ska", "wa"), "a").join(held_sk.toDF("b", "skb", "wb"), "b")
        union = F.array_union("ska", "skb")
        x = x.withColumn("u", F.when(F.col("wa") & F.col("wb"), union).otherwise(F.slice(F.array_sort(union), 1, k)))
        est = F.size(F.array_intersect("u", F.array_intersect("ska", "skb"))) / F.size("u")
        least = F.when(F.col("wa") & F.col("wb"), percent / 100 - 1e-9).otherwise(share)
        return x.withColumn("est", est).where(F.col("est") >= least).select(*cand.columns, "est")

    def confirmed(cand: DataFrame) -> DataFrame:
        x = cand.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        both = F.size(F.array_intersect("sa", "sb"))
        x = x.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb") - both).alias("u"))
        return materialize(x.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b"), "links")

    # first the hubs
    def hub(seed: int):
        return F.min(F.struct(F.xxhash64(F.lit(seed), "rep"), "rep", "n"))

    hubs = index.groupBy("val").agg(hub(1).alias("h1"), hub(2).alias("h2"), F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi")
    listed = materialize(index.join(hubs.select("val", "h1.rep", "h1.n", "h2.rep", "h2.n").toDF("val", "hub1", "n1", "hub2", "n2"), "val").drop("val").distinct(), "listed")
    first = listed.select("rep", "n", F.explode(F.array(F.struct(F.col("hub1").alias("hub"), F.col("n1").alias("hn")), F.struct(F.col("hub2").alias("hub"), F.col("n2").alias("hn")))).alias("h")).select("rep", "n", "h.*")
    first = first.where((F.col("rep") != F.col("hub")) & close("n", "hn")).select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    best = Window.partitionBy("a").orderBy(F.desc("est"), "b")
    first = estimated(first).withColumn("r", F.row_number().over(best)).where("r <= 2")
    tried = materialize(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
    links = confirmed(tried)
    comp = stars(links)

    # then every pair between different components: lists with the same hub make one group
    placed = listed.select(F.col("hub1").alias("grp"), "rep", "n").distinct().join(comp.toDF("node", "component"), F.col("rep") == F.col("node"), "left")
    placed = materialize(placed.select("grp", "rep", "n", F.coalesce("component", "rep").alias("comp")), "placed")
    main = placed.groupBy("grp", "comp").agg(F.count("*").alias("c")).groupBy("grp").agg(
        F.max(F.struct("c", "comp")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("size")).where("comps > 1")
    main = main.select("grp", F.col("m.comp").alias("main"), "size", (F.col("size") - F.col("m.c")).alias("minors"))
    rows = materialize(placed.join(main, "grp"), "rows")
    small = rows.where(F.col("size") * F.col("minors") <= PAIRS_AS_ROWS)
    minor = small.where("comp <> main").select("grp", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    pairs = minor.join(small.withColumnRenamed("rep", "b"), "grp").where(
        (F.col("ca") != F.col("comp")) & close("na", "n") & ((F.col("comp") == F.col("main")) | (F.col("a") < F.col("b"))))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    rest = materialize(estimated(pairs).select("a", "b"), "rest")
    large = rows.where(F.col("size") * F.col("minors") > PAIRS_AS_ROWS)
    more = [] if rest.isEmpty() else [confirmed(rest)]
    if not large.isEmpty():
        more.append(_linked_in_blocks(large, sets, percent))
    if more:
        comp = stars(reduce(DataFrame.union, more, comp))

    for x in (held, sets, sk, listed, placed, rows, tried, rest):
        discard(x)
    of_rep = reps.select(*keys, "rep").join(comp.toDF("node", "component"), F.col("rep") == F.col("node"), "left").select(
        *keys, F.coalesce("component", "rep").alias("root"))
    rows = all_sk.select("doc_id", *keys).join(of_rep, keys, "left")
    named = F.col("doc_id").isNotNull()
    return rows.select("doc_id", "n_shingles", F.when(named, F.coalesce("root", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
