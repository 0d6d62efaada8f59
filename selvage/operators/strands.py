"""Loose strands of lines joined end to end: free ends that are nearest to each other are tied, in rounds over all sheets.

Tied ends make paths and rings of strands.  Entering a strand at one end one
leaves it at the other and enters the strand tied there, so every end has one
next end; ways of 1, 2, 4, ... strands are found by joining ways with
themselves, and give each strand its place on its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.operators import rounds as R

_END = ["doc", "id", "side"]


def _ends(strands: DataFrame) -> DataFrame:
    both = F.array(*(F.struct(F.lit(k).alias("side"), F.element_at("points", i).alias("p")) for k, i in ((0, 1), (1, -1))))
    return strands.where(F.size("points") > 1).select("doc", "id", F.explode(both).alias("e")).select("doc", "id", "e.side", F.col("e.p")[0].alias("x"), F.col("e.p")[1].alias("y"))


def _near(ends: DataFrame, reach: float) -> DataFrame:
    """``doc, id, side, id2, side2, rank``: ends of two strands within reach, both ways; the rank of a pair is the same from either side."""
    cells = ends.withColumn("cx", F.floor(F.col("x") / reach)).withColumn("cy", F.floor(F.col("y") / reach))
    around = cells.select("doc", F.col("id").alias("id2"), F.col("side").alias("side2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    around = around.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    pairs = cells.join(around, ["doc", "cx", "cy"]).where("id <> id2").withColumn("away", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).where(F.col("away") <= reach)
    own, other = F.struct(F.col("id").alias("i"), F.col("side").alias("s")), F.struct(F.col("id2").alias("i"), F.col("side2").alias("s"))
    return pairs.select(*_END, "id2", "side2", F.struct("away", F.least(own, other).alias("a"), F.greatest(own, other).alias("b")).alias("rank"))


def tied_ends(strands: DataFrame, reach: float) -> DataFrame:
    """``doc, id, side, id2, side2``: ends tied with each other, from both sides; an end is tied once at most.

    In a round all ends that are each other's nearest are tied and leave; the
    nearest pair of all always is one, so rounds end.
    """
    left = R.written(_near(_ends(strands), reach), "near-ends")
    ties = None
    while True:
        best = left.groupBy(*_END).agg(F.min("rank").alias("rank"))
        both = left.join(best, [*_END, "rank"]).join(best.select("doc", F.col("id").alias("id2"), F.col("side").alias("side2"), "rank"), ["doc", "id2", "side2", "rank"])
        new = R.written(both.select(*_END, "id2", "side2"), "ties")
        if new.isEmpty():
            return new if ties is None else ties
        ties = new if ties is None else ties.union(new)
        gone = new.select(*_END)
        rest = left.join(gone, _END, "left_anti").join(gone.toDF("doc", "id2", "side2"), ["doc", "id2", "side2"], "left_anti")
        before = left
        left = R.written(rest.select(before.columns), "near-ends")
        R.remove(before)


def _opened(strands: DataFrame, ties: DataFrame) -> DataFrame:
    """Ties without one in every ring: that at the first end of its smallest strand."""
    nodes = strands.select("doc", "id").distinct()
    groups = R.components(nodes, ties.select("doc", F.col("id").alias("a"), F.col("id2").alias("b")))
    degree = ties.join(groups, ["doc", "id"]).groupBy("doc", "root").agg(F.count("*").alias("tied"))
    size = groups.groupBy("doc", "root").agg((2 * F.count("*")).alias("ends"))
    rings = degree.join(size, ["doc", "root"]).where("tied = ends").select("doc", F.col("root").alias("id"), F.lit(0).alias("side"))
    cut = ties.join(rings, _END)
    both = cut.select(*_END).union(cut.select("doc", "id2", "side2"))
    return ties.join(both, _END, "left_anti")


def joined_strands(strands: DataFrame, reach: float) -> DataFrame:
    """``doc, strand, points, parts, closed``: strands ``(doc, id, points)`` tied end to end within reach, named by their smallest part.

    A line runs from its end with the smaller part; ``closed`` says that its own
    ends are within reach, as those of a ring are.  Strands of fewer than two
    points are left out, repeated ids aren't allowed.
    """
    ties = R.written(tied_ends(strands, reach), "ties")
    open_ties = R.written(_opened(strands, ties), "open-ties")
    ends = _ends(strands).select(*_END)
    on = open_ties.select("doc", "id", (1 - F.col("side")).alias("side"), F.col("id2").alias("to_id"), F.col("side2").alias("to_side"))
    ways = ends.join(on, _END, "left").select(*_END, F.coalesce("to_id", "id").alias("to_id"), F.coalesce("to_side", "side").alias("to_side"), F.when(F.col("to_id").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    ways = R.written(ways, "ways")
    total = -1
    while True:
        further = ways.select("doc", F.col("id").alias("to_id"), F.col("side").alias("to_side"), F.col("to_id").alias("id3"), F.col("to_side").alias("side3"), F.col("steps").alias("more"))
        new = R.written(ways.join(further, ["doc", "to_id", "to_side"]).select(*_END, F.col("id3").alias("to_id"), F.col("side3").alias("to_side"), (F.col("steps") + F.col("more")).alias("steps")), "ways")
        R.remove(ways)
        ways, now = new, new.agg(F.sum("steps")).first()[0]
        if now == total:
            break
        total = now
    # a way that begins at a free end passes all strands of its path; of its two directions that with the smaller first strand stays
    whole = ways.groupBy("doc", "to_id", "to_side").agg(F.max_by(F.struct("id", "side"), "steps").alias("first"), F.max("steps").alias("most"), F.min("id").alias("strand"))
    keep = whole.where((F.col("first.id") < F.col("to_id")) | ((F.col("first.id") == F.col("to_id")) & (F.col("first.side") == 0)))
    placed = ways.join(keep, ["doc", "to_id", "to_side"]).join(strands.select("doc", "id", "points"), ["doc", "id"])
    run = F.when(F.col("side") == 1, F.reverse("points")).otherwise(F.col("points"))
    lines = placed.groupBy("doc", "strand").agg(F.array_sort(F.collect_list(F.struct((F.col("most") - F.col("steps")).alias("n"), run.alias("run")))).alias("runs"))
    points = F.flatten(F.transform("runs", lambda r: r["run"]))
    lines = lines.select("doc", "strand", F.size("runs").alias("parts"), F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1))))).alias("points"))
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    return lines.select("doc", "strand", "points", "parts", (_apart(first, last) <= reach).alias("closed"))


def _apart(a: Column, b: Column) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])
