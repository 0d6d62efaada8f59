"""Lettering drawn as curves: painted glyphs that stand close together in one colour, removed before tracing.

Glyph boxes of all sheets are joined by grid cells with the boxes near them;
pairs closer than their size are links, and connected components of enough
glyphs are lettering.  Equal boxes are one node, so copies at one place add
members but no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.operators import rounds as R
from selvage.operators.groups import dealt

# Largest glyph, its subpaths, points of a complex one, gap as a share of the size, glyphs of a lettering, rim around it.
GLYPH_PT, GLYPH_PARTS, COMPLEX_POINTS, GAP, LEAST, RIM_PT = 20.0, 2, 6, 0.8, 4, 2.0
#: Corners of linked boxes are at most a glyph and its gap apart.
CELL_PT = GLYPH_PT * (1 + GAP)
_BOX = ("x0", "y0", "x1", "y1")


def glyphs(subpaths: DataFrame) -> DataFrame:
    """``doc, path, color, x0, y0, x1, y1, size, complex`` of small painted paths of one or two subpaths."""
    painted = subpaths.where(F.col("style").startswith("fill") & (F.size("points") > 0)).select(
        "doc", "path", F.split_part("style", F.lit(":"), F.lit(2)).alias("color"), F.size("points").alias("n"),
        F.transform("points", lambda p: p[0]).alias("xs"), F.transform("points", lambda p: p[1]).alias("ys"))
    painted = painted.select("*", *(m(v).alias(c) for c, m, v in zip(_BOX, (F.array_min, F.array_min, F.array_max, F.array_max), ("xs", "ys", "xs", "ys"))))
    each = painted.groupBy("doc", "path", "color").agg(F.count("*").alias("parts"), F.max("n").alias("most"), *(m(c).alias(c) for c, m in zip(_BOX, (F.min, F.min, F.max, F.max))))
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return each.where(F.col("parts") <= GLYPH_PARTS).withColumn("size", size).where(F.col("size") < GLYPH_PT).select("doc", "path", "color", *_BOX, "size", (F.col("most") > COMPLEX_POINTS).alias("complex"))


def _gap() -> Column:
    """Distance of the boxes of both sides of a join; those of the second end in ``b``."""
    apart = [F.greatest(F.lit(0.0), F.col(f"{c}0") - F.col(f"{c}1b"), F.col(f"{c}0b") - F.col(f"{c}1")) for c in "xy"]
    return F.hypot(*apart)


def groups(found: DataFrame) -> DataFrame:
    """``doc, color, root, path, x0, y0, x1, y1``: the group of every complex glyph, named by its smallest path."""
    nodes = found.where("complex").groupBy("doc", "color", *_BOX, "size").agg(F.min("path").alias("id"), F.collect_list("path").alias("paths"))
    nodes = R.written(nodes, "glyphs")
    cells = nodes.withColumn("cx", F.floor(F.col("x0") / CELL_PT)).withColumn("cy", F.floor(F.col("y0") / CELL_PT)).drop("paths")
    around = cells.select("doc", "color", *(F.col(c).alias(c + "b") for c in ("id", *_BOX, "size")), F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)).alias("cx"), "cy")
    around = around.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)))
    near = cells.join(dealt(around), ["doc", "color", "cx", "cy"]).where((F.col("id") < F.col("idb")) & (_gap() <= GAP * F.greatest("size", "sizeb")))
    links = near.select("doc", F.col("id").alias("a"), F.col("idb").alias("b"))
    return R.components(nodes.select("doc", "id"), links).join(dealt(nodes), ["doc", "id"]).select("doc", "color", "root", F.explode("paths").alias("path"), *_BOX)


def letterings(grouped: DataFrame) -> DataFrame:
    """``doc, color, root, members, x0, y0, x1, y1`` of each group of at least four glyphs."""
    return grouped.groupBy("doc", "color", "root").agg(F.count("*").alias("members"), *(m(c).alias(c) for c, m in zip(_BOX, (F.min, F.min, F.max, F.max)))).where(F.col("members") >= LEAST)


def lettering_paths(subpaths: DataFrame) -> DataFrame:
    """``doc, path`` of lettering: its complex glyphs, and simple ones of its colour whose middle lies inside its bounds.

    Strokes, painted paths of many subpaths (dashes) and large ones never are;
    nor is a complex glyph that lies inside the bounds but stands apart.
    """
    found = R.written(glyphs(subpaths), "glyph-boxes")
    grouped = R.written(groups(found), "glyph-groups")
    own = R.written(letterings(grouped), "letterings")
    cell = 200.0
    simple = found.where("NOT complex").select("doc", "path", "color", ((F.col("x0") + F.col("x1")) / 2).alias("mx"), ((F.col("y0") + F.col("y1")) / 2).alias("my"))
    simple = simple.withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    wide = own
    for k, c in enumerate(("cx", "cy")):
        wide = wide.withColumn(c, F.explode(F.sequence(F.floor((F.col(_BOX[k]) - RIM_PT) / cell), F.floor((F.col(_BOX[k + 2]) + RIM_PT) / cell))))
    inside = F.col("mx").between(F.col("x0") - RIM_PT, F.col("x1") + RIM_PT) & F.col("my").between(F.col("y0") - RIM_PT, F.col("y1") + RIM_PT)
    within = simple.join(dealt(wide), ["doc", "color", "cx", "cy"]).where(inside).select("doc", "path")
    return grouped.join(dealt(own.select("doc", "root")), ["doc", "root"], "left_semi").select("doc", "path").union(within).distinct()


def without_lettering(subpaths: DataFrame) -> DataFrame:
    """Subpaths of everything but lettering; ``subpaths(doc, path, sub, points, style)``."""
    return subpaths.join(dealt(lettering_paths(subpaths)), ["doc", "path"], "left_anti")
