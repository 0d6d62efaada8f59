"""Embedding near-duplicates by dual traversal of cover trees.

On unit vectors a cosine of at least ``c`` is a Euclidean distance of at most
``sqrt(2 - 2c)``.  Equal vectors of a label are one point.  A label with more
points than a task should hold is cut into cells around pivots, and cells again
around further pivots until they fit: the top levels of its tree.  Pairs of
cells whose centres are farther apart than both covering radii and the threshold
are never compared.

A task holds two cells, builds the cover tree of each (nested levels with
halving radii, down to single points) and walks both trees level by level.  A
pair of nodes is dropped where its centres are farther apart than both covering
radii and the threshold, and settled as a whole where even its farthest points
lie within the threshold; pairs of single points are decided by their cosine in
double precision on the original vectors, in bounded blocks.  Links are counted
and components joined as pairs are found: neither a task's memory nor its output
grows with the pairs of a group.

Where no two vectors are near each other (random directions in many dimensions)
the first level below the root holds all points, and a pair of nodes is a pair
of points: then the bounds prune after one distance each, and the work within a
label is quadratic, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, if_small, materialize
from .vectors import distinct_vectors, usable

#: Points of a cell, pivots of a cell with more points than that, points that one task assigns to pivots.
BLOCK = 8192
PIVOTS = 64
CHUNK = 4096
#: Rounds of pivots; cells that are still too large then are cut by hash, which keeps their centre and radius.
SPLITS = 6
SLACK = 1e-6
CLOSEST = 1e-7


@dataclass
class Level:
    """Nodes in the order of ``Tree.order``: a node's points and its children are consecutive."""

    reach: float
    center: np.ndarray  # point of each node
    radius: np.ndarray  # of its points around the centre
    first: np.ndarray  # its points are order[first[k]:first[k + 1]]
    child: np.ndarray  # its children are the nodes child[k] to child[k + 1] of the next level


@dataclass
class Tree:
    unit: np.ndarray
    order: np.ndarray
    levels: list[Level]


def _away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def cover_tree(unit: np.ndarray) -> Tree:
    """Levels of reach 2, 1, 1/2, ...: centres of a level are farther apart than its reach, stay centres below, and lie within the reach above of their parent.

    The last level holds every point; equal directions are told apart only there.
    """
    n = len(unit)
    born = np.full(n, -1)  # level at which a point becomes a centre
    parent = np.zeros(n, int)
    near, owner = _away(unit, unit[:1])[:, 0], np.zeros(n, int)
    born[0] = 0
    reaches = [2.0]
    while (born < 0).any() and reaches[-1] > CLOSEST:
        reach = reaches[-1] / 2
        level = len(reaches)
        reaches.append(reach)
        above = owner.copy()  # the nearest centre of the level above
        far = np.flatnonzero((born < 0) & (near > reach))
        for s in range(0, len(far), 512):
            part = far[s:s + 512]
            part = part[near[part] > reach]  # the parts before may have covered them
            if not len(part):
                continue
            gap = _away(unit[part], unit[part])
            free, new = np.ones(len(part), bool), []
            while free.any():
                k = int(free.argmax())
                new.append(k)
                free &= gap[k] > reach
                free[k] = False
            new = part[new]
            born[new], parent[new] = level, above[new]
            rest = np.flatnonzero(born < 0)
            d = _away(unit[rest], unit[new])
            best = d.argmin(1)
            closer = d[np.arange(len(rest)), best] < near[rest]
            near[rest[closer]], owner[rest[closer]] = d[np.arange(len(rest)), best][closer], new[best[closer]]
    left = born < 0
    if left.any() or len(reaches) == 1:
        reaches.append(0.0)
        born[left], parent[left] = len(reaches) - 1, owner[left]
    depth = len(reaches)
    chain = np.zeros((depth, n), int)  # a point's ancestor at each level
    chain[depth - 1] = np.arange(n)
    for k in range(depth - 1, 0, -1):
        now = chain[k]
        chain[k - 1] = np.where(born[now] == k, parent[now], now)
    order = np.lexsort(chain[::-1])
    levels, before = [], None
    for k in range(depth):
        own = chain[k][order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        radius = np.maximum.reduceat(np.linalg.norm(unit[order] - unit[own], axis=1), first)
        levels.append(Level(reaches[k], own[first], radius, np.append(first, n), np.empty(0, int)))
        if before is not None:
            before.child = np.searchsorted(first, before.first)
        before = levels[-1]
    return Tree(unit, order, levels)


#: Node pairs of at most so many point pairs are decided point by point; point pairs and cells of a matrix held at once.
TINY = 4096
HELD = 1 << 18
#: A pair of nodes is decided point by point too if that is at most so many times the work of comparing their children.
BROAD = 64


class Found:
    """Collects what a traversal finds: node pairs that are links as a whole, as ranges of both orders, and point pairs to decide."""

    def __init__(self) -> None:
        self.sure: list[tuple[int, int, int, int]] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0, int))]
        self.compared = 0

    def whole(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        self.sure += zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist())

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pairs.append((i, j))

    def block(self, x: np.ndarray, y: np.ndarray, away: np.ndarray, within: float) -> None:
        i, j = np.nonzero(away <= within + SLACK)
        self.points(x[i], y[j])

    @property
    def left(self) -> np.ndarray:
        return np.concatenate([i for i, _ in self.pairs])

    @property
    def right(self) -> np.ndarray:
        return np.concatenate([j for _, j in self.pairs])


def dual_traversal(a: Tree, b: Tree, within: float, found: Found | None = None) -> Found:
    """Hands all pairs that may lie within the distance to ``found``, in bounded blocks; with ``a is b`` each unordered pair once.

    Node pairs wait on a stack, deepest first, so that what is held at once
    grows with the depth of the trees and not with the number of pairs.
    """
    found = Found() if found is None else found
    same, depth = a is b, max(len(a.levels), len(b.levels))
    found.compared += 1
    todo = [(0, np.zeros(1, int), np.zeros(1, int))]
    while todo:
        k, u, v = todo.pop()
        la, lb = (t.levels[min(k, len(t.levels) - 1)] for t in (a, b))
        na, nb = (t.levels[min(k + 1, len(t.levels) - 1)] for t in (a, b))
        ca, cb = (x.child if y is not x else np.arange(len(x.center) + 1) for x, y in ((la, na), (lb, nb)))
        product = np.diff(la.first)[u] * np.diff(lb.first)[v]
        tiny = (product <= TINY) | (k >= depth - 1)
        broad = ~tiny & (product <= BROAD * np.diff(ca)[u] * np.diff(cb)[v])
        _by_point(a, b, la, lb, u[tiny], v[tiny], found)
        for x, y in zip(u[broad].tolist(), v[broad].tolist()):
            y0, y1 = lb.first[y], lb.first[y + 1]
            step = max(HELD // (y1 - y0), 1)
            for s in range(la.first[x], la.first[x + 1], step):
                rows, columns = a.order[s:min(s + step, la.first[x + 1])], b.order[y0:y1]
                d = _away(a.unit[rows], b.unit[columns])
                found.compared += d.size
                if same and x == y:
                    d[np.arange(s, s + len(rows))[:, None] >= np.arange(y0, y1)[None, :]] = np.inf
                found.block(rows, columns, d, within)
        rest = ~tiny & ~broad
        next_u, next_v, waiting = [], [], 0
        for x, y in zip(u[rest].tolist(), v[rest].tolist()):
            y0, y1 = cb[y], cb[y + 1]
            step = max(HELD // (y1 - y0), 1)
            for s in range(ca[x], ca[x + 1], step):
                e = min(s + step, ca[x + 1])
                d = _away(a.unit[na.center[s:e]], b.unit[nb.center[y0:y1]])
                both = na.radius[s:e, None] + nb.radius[None, y0:y1]
                found.compared += d.size
                keep = d <= both + within + SLACK
                if same and x == y:
                    keep &= np.arange(s, e)[:, None] <= np.arange(y0, y1)[None, :]
                sure = keep & (d + both <= within - SLACK)
                i, j = np.nonzero(sure)
                i, j = i + s, j + y0
                if same and x == y:  # a point is no pair with itself
                    more = (i != j) | (np.diff(na.first)[i] > 1)
                    i, j = i[more], j[more]
                if len(i):
                    found.whole(na.first[i], na.first[i + 1], nb.first[j], nb.first[j + 1])
                i, j = np.nonzero(keep & ~sure)
                next_u.append(i + s)
                next_v.append(j + y0)
                waiting += len(i)
            if waiting > HELD:
                todo.append((k + 1, np.concatenate(next_u), np.concatenate(next_v)))
                next_u, next_v, waiting = [], [], 0
        if waiting:
            todo.append((k + 1, np.concatenate(next_u), np.concatenate(next_v)))
    return found


def _by_point(a: Tree, b: Tree, la: Level, lb: Level, u: np.ndarray, v: np.ndarray, found: Found) -> None:
    """All point pairs of the node pairs, in blocks."""
    wide = np.diff(lb.first)[v]
    size = np.diff(la.first)[u] * wide
    ends = np.cumsum(size)
    start = 0
    while start < len(u):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, "right")), start + 1)
        own = np.repeat(np.arange(start, stop), size[start:stop])
        at = np.arange(len(own)) - np.repeat(ends[start:stop] - size[start:stop] - (ends[start - 1] if start else 0), size[start:stop])
        i, j = la.first[u[own]] + at // wide[own], lb.first[v[own]] + at % wide[own]
        if a is b:
            once = (u[own] != v[own]) | (i < j)
            i, j = i[once], j[once]
        found.compared += len(i)
        found.points(a.order[i], b.order[j])
        start = stop


class Forest:
    """Components of points as a forest in one array."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            i, j = self.parent[i], self.parent[j]
            apart = i != j
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(i, j), np.minimum(i, j))
            while True:  # every way up halves, so a long chain takes few steps
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


class Links(Found):
    """Counts links and joins components as the traversal goes; no pair is kept."""

    def __init__(self, a: Tree, b: Tree, at_a: np.ndarray, at_b: np.ndarray, vectors: np.ndarray, norm: np.ndarray, copies: np.ndarray, cosine: float) -> None:
        super().__init__()
        self.same, self.at = a is b, (at_a, at_b)
        self.orders = (at_a[a.order], at_b[b.order])
        self.vectors, self.norm, self.copies, self.cosine = vectors, norm, copies.astype(float), cosine
        self.links = np.zeros(len(norm))
        self.forest = Forest(len(norm))
        #: By position in each order: what is added to the links from there on, and whether the position is joined with the one before.
        self.more = tuple(np.zeros(len(o) + 1) for o in self.orders)
        self.tied = tuple(np.zeros(len(o) + 2) for o in self.orders)
        self.upto = tuple(np.concatenate([[0], np.cumsum(self.copies[o])]) for o in self.orders)

    def whole(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> None:
        """Every point of each first range is linked with every point of the second."""
        own = (a0 == b0) & self.same
        for k, (lo, hi), (other_lo, other_hi) in ((0, (a0, a1), (b0, b1)), (1, (b0, b1), (a0, a1))):
            add = self.upto[1 - k][other_hi] - self.upto[1 - k][other_lo]
            add = np.where(own, add if k == 0 else 0, add)
            np.add.at(self.more[k], lo, add)
            np.add.at(self.more[k], hi, -add)
            np.add.at(self.tied[k], lo + 1, 1)
            np.add.at(self.tied[k], hi, -1)
        for lo, hi in zip(a0[own].tolist(), a1[own].tolist()):  # but not with itself
            self.links[self.orders[0][lo:hi]] -= self.copies[self.orders[0][lo:hi]]
        self.forest.join(self.orders[0][a0], self.orders[1][b0])

    def points(self, i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), 1 << 16):
            self._decided(self.at[0][i[s:s + (1 << 16)]], self.at[1][j[s:s + (1 << 16)]])

    def _decided(self, i: np.ndarray, j: np.ndarray) -> None:
        hit = (self.vectors[i] * self.vectors[j]).sum(1) / (self.norm[i] * self.norm[j]) >= self.cosine
        i, j = i[hit], j[hit]
        self.links += np.bincount(i, self.copies[j], len(self.links)) + np.bincount(j, self.copies[i], len(self.links))
        self.forest.join(i, j)

    def block(self, x: np.ndarray, y: np.ndarray, away: np.ndarray, within: float) -> None:
        sure = away <= within - SLACK
        gx, gy = self.at[0][x], self.at[1][y]
        self.links[gx] += sure @ self.copies[gy]
        self.links[gy] += self.copies[gx] @ sure
        i, j = np.nonzero(sure)
        self.forest.join(gx[i], gy[j])
        i, j = np.nonzero((away > within - SLACK) & (away <= within + SLACK))
        self.points(x[i], y[j])

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of every point, and the root of its component."""
        links = self.links.copy()
        for k in (0, 1):
            np.add.at(links, self.orders[k], np.cumsum(self.more[k])[:-1])
            tied = np.flatnonzero(np.cumsum(self.tied[k])[:len(self.orders[k])] > 0.5)
            self.forest.join(self.orders[k][tied], self.orders[k][tied - 1])
        return np.rint(links), self.forest.parent


def compare(key: tuple, part: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between two cells, or inside one: a row for each linked point, its number of links and a point it is connected with."""
    vectors = np.stack(part["embedding"].to_numpy()).astype(float)
    vectors /= np.abs(vectors).max(1, keepdims=True)  # the cosine stays, and no square overflows or vanishes
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / norm[:, None]
    side, ids, copies = part["side"].to_numpy(), part["rep"].to_numpy(), part["copies"].to_numpy()
    a = np.flatnonzero(side == 0)
    b = a if key[0] == key[1] else np.flatnonzero(side == 1)
    first = cover_tree(unit[a])
    second = first if b is a else cover_tree(unit[b])
    links, root = dual_traversal(first, second, float(np.sqrt(2 - 2 * cosine)), Links(first, second, a, b, vectors, norm, copies, cosine)).result()
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    linked = links > 0
    return pd.DataFrame({"rep": ids[linked], "links": links[linked].astype("int64"), "other": least[root][linked]})


def _nearest(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
    """Rows with the nearest pivot and its distance; a cell without pivots keeps the one that it has."""
    rows = rows.drop(columns=["n", "chunk"])
    if len(rows) and len(own):
        own = own.sort_values("p")
        x, p = (np.stack(v.to_numpy()).astype(float) for v in (rows["embedding"], own["center"]))
        x, p = (v / np.abs(v).max(1, keepdims=True) for v in (x, p))
        d = _away(x / np.linalg.norm(x, axis=1, keepdims=True), p / np.linalg.norm(p, axis=1, keepdims=True))
        rows = rows.assign(pivot=own["p"].to_numpy()[d.argmin(1)], away=d.min(1))
    return rows


def _cells(points: DataFrame) -> DataFrame:
    """``points`` with ``cell``, its ``pivot`` (null if it has none) and ``away``, the distance from it; cells of at most about BLOCK points."""
    cells = materialize(points.select("*", F.xxhash64("label", "dim").alias("cell"), F.lit(None).cast("long").alias("pivot"), F.lit(2.0).alias("away")), "cells")
    for depth in range(SPLITS):
        large = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "large")
        if large.isEmpty():
            return cells
        rows = cells.join(if_small(large), "cell", "left")
        wide = rows.where("n IS NOT NULL").withColumn("chunk", F.pmod(F.xxhash64(F.lit(3 + depth), "rep"), F.ceil(F.col("n") / CHUNK)))
        # about PIVOTS points of each cell, chosen by hash, for every chunk of it
        chosen = wide.where(F.pmod(F.xxhash64(F.lit(50 + depth), "rep"), F.lit(1 << 20)) < F.lit(PIVOTS * float(1 << 20)) / F.col("n"))
        pivots = chosen.select(F.col("cell").alias("pc"), F.col("rep").alias("p"), F.col("embedding").alias("center"), F.explode(F.expr(f"sequence(0L, CAST(ceil(n / {CHUNK}) - 1 AS BIGINT))")).alias("pk"))
        found = wide.groupBy("cell", "chunk").cogroup(pivots.groupBy("pc", "pk")).applyInPandas(_nearest, cells.schema)
        new = found.withColumn("cell", F.xxhash64("cell", "pivot"))
        new = materialize(rows.where("n IS NULL").drop("n").select(new.columns).union(new), "cells")
        discard(cells)
        discard(large)
        cells = new
    fill = cells.groupBy("cell").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64(F.lit(2), "rep"), F.ceil(F.col("n") / BLOCK))
    return cells.join(fill, "cell").withColumn("cell", F.xxhash64("cell", part)).drop("n").select(cells.columns)


def linked_vectors(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``vec_id, embedding, label``, a row for each input row.

    Vectors link only under equal labels, equal dimension and with a cosine of at
    least ``cosine`` in double precision.  Vectors that are null, empty, zero or
    hold null or non-finite components, and rows without a label, link with
    nothing.  Rows repeating a ``vec_id`` count as one vector and repeat its
    result.  Other columns are ignored; an empty table gives an empty result.
    """
    able = rows.select("vec_id", "embedding", "label").where(usable() & F.col("label").isNotNull())
    points = materialize(distinct_vectors(able, "label").withColumn("dim", F.size("embedding")), "points")
    cells = materialize(_cells(points), "cells")
    center = points.select(F.col("label").alias("cl"), F.col("rep").alias("pivot"), _unit("embedding").alias("center"))
    balls = cells.groupBy("label", "dim", "cell").agg(F.max("pivot").alias("pivot"), F.max("away").alias("radius"))
    balls = balls.join(center, (F.col("label") == F.col("cl")) & (balls["pivot"] == center["pivot"]), "left").select("label", "dim", "cell", "radius", "center")
    balls = materialize(balls, "balls")
    a = balls.select("label", "dim", *(F.col(c).alias(c + "1") for c in ("cell", "center", "radius")))
    b = balls.select("label", "dim", *(F.col(c).alias(c + "2") for c in ("cell", "center", "radius")))
    within = float(np.sqrt(2 - 2 * cosine)) + SLACK
    near = F.coalesce(_distance("center1", "center2") <= F.col("radius1") + F.col("radius2") + within, F.lit(True))
    pairs = a.join(b, ["label", "dim"]).where((F.col("cell1") == F.col("cell2")) | (F.col("cell1") < F.col("cell2")) & near)
    sides = [F.struct(F.col(f"cell{k + 1}").alias("cell"), F.lit(k).alias("side")) for k in (0, 1)]
    wide = pairs.select("cell1", "cell2", F.explode(F.when(F.col("cell1") == F.col("cell2"), F.array(sides[0])).otherwise(F.array(*sides))).alias("s"))
    wide = materialize(wide.select("cell1", "cell2", "s.cell", "s.side"), "pairs").join(cells.select("cell", "rep", "copies", "embedding"), "cell")
    found = materialize(wide.groupBy("cell1", "cell2").applyInPandas(lambda key, part: compare(key, part, cosine), "rep long, links long, other long"), "found")

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    of_rep = points.select("label", "embedding", "rep", "copies").join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("root"))
    of_rep = of_rep.where(F.col("links") > 0)
    out = rows.select("vec_id", "embedding", "label").join(of_rep, ["label", "embedding"], "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").cast("long").alias("component_id")).withColumn(
        "kept", F.col("vec_id") == F.col("component_id"))


def _unit(v: str):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _distance(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
