"""Bundles of lines that run side by side, as the sizes of one edge do: their envelope and their centre line, station by station.

Stations lie at equal steps along x.  Every segment gives its value at the
stations that it spans, and what remains are aggregates by station, so strokes
may be split over pages in any way and need no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Step of stations, how far a centre line is drawn out at both ends, over how many stations its direction there is taken.
STEP_PT, EXTEND_PT, LEAD = 3.0, 40.0, 5


def stations(strokes: DataFrame, step: float = STEP_PT) -> DataFrame:
    """``doc, k, x, low, middle, high, strokes`` of ``strokes(doc, id, points)``: the outermost values of all strokes at a station, and the mean of their middles.

    The first station is the leftmost point of a document.  A stroke of several
    values at a station (a closed one, or one that turns back) has its middle
    between the outermost; parts under one ``id`` are one stroke.  Stations
    that no stroke spans have no row, nor have strokes of fewer than two points.
    """
    n = F.size("points")
    rows = strokes.where(n >= 2).select("doc", "id", F.explode(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.struct(F.get("points", i - 1).alias("p"), F.get("points", i).alias("q")))).alias("s"))
    rows = rows.select("doc", "id", *(F.col(f"s.{v}")[k].alias(f"{c}{v}") for v in "pq" for k, c in enumerate("xy")))
    first = rows.groupBy("doc").agg(F.min(F.least("xp", "xq")).alias("from"))
    rows = rows.join(first, "doc").withColumn("k0", F.ceil((F.least("xp", "xq") - F.col("from")) / step)).withColumn("k1", F.floor((F.greatest("xp", "xq") - F.col("from")) / step))
    at = rows.where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("x", F.col("from") + F.col("k") * step)
    share = F.when(F.col("xq") == F.col("xp"), 0.0).otherwise((F.col("x") - F.col("xp")) / F.when(F.col("xq") == F.col("xp"), 1.0).otherwise(F.col("xq") - F.col("xp")))
    each = at.withColumn("y", F.col("yp") + (F.col("yq") - F.col("yp")) * share).groupBy("doc", "k", "x", "id").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    return each.groupBy("doc", "k", "x").agg(F.min("low").alias("low"), F.avg((F.col("low") + F.col("high")) / 2).alias("middle"), F.max("high").alias("high"), F.count("*").alias("strokes"))


def _drawn_out(end: Column, inner: Column, by: float) -> Column:
    """The point beyond an end, in the direction from an inner point."""
    dx, dy = end["x"] - inner["x"], end["y"] - inner["y"]
    away = F.hypot(dx, dy)
    return F.when(away > 0, F.struct((end["x"] + dx / away * by).alias("x"), (end["y"] + dy / away * by).alias("y"))).otherwise(end)


def centre_lines(found: DataFrame, extend: float = EXTEND_PT) -> DataFrame:
    """``doc, points``: the middles of :func:`stations` in order, drawn out at both ends in the direction that the line has there."""
    line = found.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x", "middle"))), lambda s: F.struct(s["x"].alias("x"), s["middle"].alias("y"))).alias("line"))
    n = F.size("line")
    head = _drawn_out(F.get("line", F.lit(0)), F.get("line", F.least(F.lit(LEAD), n - 1)), extend)
    tail = _drawn_out(F.get("line", n - 1), F.get("line", F.greatest(n - 1 - LEAD, F.lit(0))), extend)
    return line.select("doc", F.transform(F.concat(F.array(head), "line", F.array(tail)), lambda p: F.array(p["x"], p["y"])).alias("points"))
