"""Sheets of tiled pages: repeated furniture, matching pages, assembly, line styles, scale.

``subpaths(doc, page, path, sub, points, closed, style)`` holds a row for each
polyline, ``texts(doc, page, str, x, y, height)`` one for each text.  Tolerance
joins look into the neighbouring buckets of an anchor by an explode and an
equi-join, then verify every point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.functions import text as X
from selvage.operators.groups import dealt

# Tolerances in points, and sides of usual test squares in cm.
FURNITURE_PT, ASSEMBLY_PT, MATCH_PT = 0.3, 0.2, 0.6
SHORTEST_FEATURE_PT = 12.0
REPEATS_PER_PAGE = 4
BLOCK_GAP_PT = 36.0
CM_PER_PT = 2.54 / 72
STANDARD_SIDES_CM = (2.54, 3.0, 4.0, 5.0, 5.08, 10.0, 10.16)


def _round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def shape_key(points: Column | str, relative: bool = True) -> Column:
    """Point count and up to eight rounded points, seen from the first one if ``relative``."""
    p = F.col(points) if isinstance(points, str) else points
    n = F.size(p)
    few = F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1)), F.get(p, F.floor(n / 3).cast("int")), F.get(p, F.floor(n * 2 / 3).cast("int")), F.element_at(p, -1))
    sample = F.when(n <= 8, p).otherwise(few)
    x, y = (F.get(F.get(p, F.lit(0)), F.lit(k)) if relative else F.lit(0.0) for k in (0, 1))
    return F.concat_ws(":", n.cast("string"), F.array_join(F.transform(sample, lambda q: F.concat_ws(",", _round((q[0] - x) * 2), _round((q[1] - y) * 2))), ";"))


def polyline_length(points: Column | str, closed: Column | bool = False) -> Column:
    p = F.col(points) if isinstance(points, str) else points
    closed = closed if isinstance(closed, Column) else F.lit(closed)
    steps = F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(2), F.size(p)), lambda i: G.distance(F.element_at(p, i - 1), F.element_at(p, i)))).otherwise(F.array().cast("array<double>"))
    total = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
    return total + F.when(closed & (F.size(p) > 0), G.distance(F.element_at(p, 1), F.element_at(p, -1))).otherwise(0.0)


def _close(a: Column, b: Column, within: float, strict: bool) -> Column:
    def ok(p: Column, q: Column) -> Column:
        dx, dy = F.abs(p[0] - q[0]), F.abs(p[1] - q[1])
        return (dx < within) & (dy < within) if strict else (dx <= within) & (dy <= within)

    return F.forall(F.zip_with(a, b, ok), lambda v: v)


def _twins(rows: DataFrame, keys: list[str], within: float, strict: bool) -> DataFrame:
    """Pairs ``i, j`` of rows with equal keys and all points within the tolerance; ``i`` itself included."""
    first = F.get("points", F.lit(0))
    cell = rows.withColumn("cx", _round(first[0] / within)).withColumn("cy", _round(first[1] / within))
    around = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)))
    left = cell.withColumn("d", F.explode(around)).select(*keys, F.col("row").alias("i"), F.col("points").alias("pi"), (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"))
    right = cell.select(*keys, F.col("row").alias("j"), F.col("points").alias("pj"), "cx", "cy")
    return left.join(dealt(right), [*keys, "cx", "cy"]).where((F.size("pi") == F.size("pj")) & _close(F.col("pi"), F.col("pj"), within, strict)).drop("cx", "cy", "pi", "pj")


def numbered(subpaths: DataFrame) -> DataFrame:
    """Adds ``row``, the position within a document."""
    return subpaths.withColumn("row", F.row_number().over(Window.partitionBy("doc").orderBy("page", "path", "sub")))


def _repeated_shapes(subpaths: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, points`` of what furniture looks like.  Equal subpaths of a document are one shape with the pages that it is on."""
    equal = subpaths.groupBy("doc", "points").agg(F.collect_set("page").alias("pages")).withColumn("row", F.col("points")).withColumn("n", F.size("points"))
    on = equal.select("doc", F.col("row").alias("j"), F.explode("pages").alias("page"))
    seen = _twins(equal, ["doc", "n"], FURNITURE_PT, strict=False).join(dealt(on), ["doc", "j"]).groupBy("doc", F.col("i").alias("points")).agg(F.count_distinct("page").alias("on"))
    need = pages.groupBy("doc").agg(F.greatest(F.lit(2), F.ceil(F.count("*") / 2)).alias("need"))
    return seen.join(dealt(need), "doc").where("on >= need").select("doc", "points")


def furniture(subpaths: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, row`` of subpaths found at the same place on at least half of a document's pages, and two."""
    return numbered(subpaths).join(dealt(_repeated_shapes(subpaths, pages)), ["doc", "points"], "left_semi").select("doc", "row")


def content(subpaths: DataFrame, pages: DataFrame) -> DataFrame:
    """Subpaths that aren't page furniture."""
    rows = numbered(subpaths)
    return rows.join(dealt(_repeated_shapes(subpaths, pages)), ["doc", "points"], "left_anti").select(*rows.columns)


def page_matches(subpaths: DataFrame, top: int = 4) -> DataFrame:
    """``doc, a, b, dx, dy, votes``: shifts at which pages share shapes, the ``top`` best of each pair of pages.

    Equal shapes are joined by their key and verified at every point; shapes
    that a page repeats more than four times say nothing.  Shifts are grouped to
    the nearest point and averaged.
    """
    rows = numbered(subpaths).where(F.size("points") >= 2).withColumn("key", shape_key("points")).where(polyline_length("points") >= SHORTEST_FEATURE_PT)
    often = rows.groupBy("doc", "key", "page").agg(F.count("*").alias("c")).where(F.col("c") > REPEATS_PER_PAGE)
    rows = rows.join(often, ["doc", "key", "page"], "left_anti").select("doc", "key", "page", "points")
    a, b = rows.toDF("doc", "key", "a", "pa"), rows.toDF("doc", "key", "b", "pb")
    pairs = a.join(b, ["doc", "key"]).where("a < b")
    dx, dy = F.col("pa")[0][0] - F.col("pb")[0][0], F.col("pa")[0][1] - F.col("pb")[0][1]
    pairs = pairs.withColumn("dx", dx).withColumn("dy", dy).where(F.hypot("dx", "dy") >= 5)
    same = F.forall(F.zip_with("pa", "pb", lambda p, q: (F.abs(p[0] - q[0] - F.col("dx")) < MATCH_PT) & (F.abs(p[1] - q[1] - F.col("dy")) < MATCH_PT)), lambda v: v)
    votes = pairs.where(same).groupBy("doc", "a", "b", _round(F.col("dx")).alias("kx"), _round(F.col("dy")).alias("ky")).agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy"), F.count("*").alias("votes"))
    best = Window.partitionBy("doc", "a", "b").orderBy(F.desc("votes"), "kx", "ky")
    return votes.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("doc", "a", "b", "dx", "dy", "votes")


def place_pages(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc, page, block, row, col, x, y`` from ``blocks(doc, block, first, rows, step_x, step_y)``: row by row, blocks side by side."""
    cells = blocks.select("doc", "block", "first", "step_x", "step_y", F.posexplode("rows").alias("row", "count"))
    before = Window.partitionBy("doc", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.col("first") + F.coalesce(F.sum("count").over(before), F.lit(0)))
    cells = cells.select("doc", "block", "row", "step_x", "step_y", "start", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("col"))
    cells = cells.withColumn("page", (F.col("start") + F.col("col")).cast("int")).join(pages.select("doc", "page", "width"), ["doc", "page"])
    wide = cells.groupBy("doc", "block").agg(F.max(F.col("col") * F.col("step_x") + F.col("width")).alias("w"))
    left = wide.withColumn("left", F.coalesce(F.sum(F.col("w") + BLOCK_GAP_PT).over(Window.partitionBy("doc").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return cells.join(left.select("doc", "block", "left"), ["doc", "block"]).select(
        "doc", "page", "block", "row", "col", (F.col("left") + F.col("col") * F.col("step_x")).alias("x"), (F.col("row") * F.col("step_y")).cast("double").alias("y"))


def seams(placements: DataFrame, matches: DataFrame) -> DataFrame:
    """``doc, a, b, matched`` of neighbouring pages."""
    a, b = placements.select("doc", "block", *(F.col(c).alias(f"{c}1") for c in ("page", "row", "col", "x", "y"))), placements.select("doc", "block", *(F.col(c).alias(f"{c}2") for c in ("page", "row", "col", "x", "y")))
    near = a.join(b, ["doc", "block"]).where("(col2 = col1 + 1 AND row2 = row1) OR (row2 = row1 + 1 AND col2 = col1)")
    m = matches.where("votes >= 2").select("doc", F.col("a").alias("page1"), F.col("b").alias("page2"), "dx", "dy")
    hit = near.join(m, ["doc", "page1", "page2"]).where((F.abs(F.col("dx") - F.col("x2") + F.col("x1")) < 1) & (F.abs(F.col("dy") - F.col("y2") + F.col("y1")) < 1)).select("doc", "page1", "page2").distinct()
    out = near.select("doc", "page1", "page2").join(hit.withColumn("hit", F.lit(True)), ["doc", "page1", "page2"], "left")
    return out.select("doc", F.col("page1").alias("a"), F.col("page2").alias("b"), F.coalesce("hit", F.lit(False)).alias("matched"))


def unused_pages(pages: DataFrame, placements: DataFrame) -> DataFrame:
    return pages.select("doc", "page").join(placements.select("doc", "page"), ["doc", "page"], "left_anti")


def assemble_paths(subpaths: DataFrame, placements: DataFrame) -> DataFrame:
    """Subpaths in sheet space; of near-identical ones of a style the first stays.

    A row goes if an earlier one lies within the tolerance at every point.
    """
    rows = subpaths.where(F.size("points") >= 2).join(placements.select("doc", "page", "x", "y"), ["doc", "page"])
    rows = numbered(rows.withColumn("points", G.translate("points", F.col("x"), F.col("y"))).drop("x", "y")).withColumn("n", F.size("points"))
    later = _twins(rows, ["doc", "n", "closed", "style"], ASSEMBLY_PT, strict=True).where("j < i").select("doc", F.col("i").alias("row")).distinct()
    return rows.join(later, ["doc", "row"], "left_anti").drop("n")


def assemble_texts(texts: DataFrame, placements: DataFrame) -> DataFrame:
    """Texts in sheet space, one for each string and half point."""
    rows = texts.join(placements.select("doc", "page", F.col("x").alias("px"), F.col("y").alias("py")), ["doc", "page"])
    rows = rows.withColumn("x", F.col("x") + F.col("px")).withColumn("y", F.col("y") + F.col("py")).drop("px", "py")
    first = Window.partitionBy("doc", "str", _round(F.col("x") * 2), _round(F.col("y") * 2)).orderBy("page", "y", "x")
    return rows.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def style_legend(subpaths: DataFrame) -> DataFrame:
    """``doc, style, paths, length_pt, closed_length_pt``, longest first; thin painted bands count half their outline."""
    first, last = F.element_at("points", 1), F.element_at("points", -1)
    shut = F.col("closed") | ((F.size("points") > 2) & (G.distance(first, last) < 0.01))
    rows = subpaths.withColumn("shut", shut).withColumn("len", polyline_length("points", F.col("shut")) / F.when(F.col("style").startswith("fill"), 2).otherwise(1))
    return rows.groupBy("doc", "style").agg(
        F.count_distinct("page", "path").alias("paths"), F.sum("len").alias("length_pt"), F.sum(F.when(F.col("shut"), F.col("len")).otherwise(0.0)).alias("closed_length_pt")).orderBy("doc", F.desc("length_pt"), "style")


def default_assignment(legend: DataFrame) -> DataFrame:
    """``doc, style`` of the closed style that dominates: 300 pt at least, and twice all the others."""
    own = Window.partitionBy("doc")
    ranked = legend.withColumn("r", F.row_number().over(own.orderBy(F.desc("closed_length_pt"), "style"))).withColumn("all", F.sum("closed_length_pt").over(own))
    return ranked.where((F.col("r") == 1) & (F.col("closed_length_pt") >= 300) & (F.col("closed_length_pt") > 2 * (F.col("all") - F.col("closed_length_pt")))).select("doc", "style")


def dominant_style(legend: DataFrame, share: float = 0.8) -> DataFrame:
    total = F.sum("length_pt").over(Window.partitionBy("doc"))
    return legend.withColumn("all", total).where(F.col("length_pt") > share * F.col("all")).select("doc", "style")


def square_side(points: Column | str, closed: Column) -> Column:
    """Side of an axis-parallel closed square of 60 to 320 pt; null otherwise."""
    p = F.col(points) if isinstance(points, str) else points
    b = G.bbox(p)
    w, h = b["width"], b["height"]
    right = F.forall(G.edges(p), lambda e: ((F.abs(e["a"][0] - e["b"][0]) <= 0.3) | (F.abs(e["a"][1] - e["b"][1]) <= 0.3)) & (
        F.least(F.abs(e["a"][0] - b["min_x"]), F.abs(e["a"][0] - b["max_x"])) <= 0.3) & (F.least(F.abs(e["a"][1] - b["min_y"]), F.abs(e["a"][1] - b["max_y"])) <= 0.3))
    ok = F.size(p).between(4, 5) & closed & w.between(60, 320) & (F.abs(w - h) <= F.greatest(F.lit(0.8), w * 0.01)) & (F.abs(G.area(p) / (w * h) - 1) <= 0.01) & right
    return F.when(ok, (w + h) / 2)


def square_candidates(subpaths: DataFrame, texts: DataFrame) -> DataFrame:
    """Test squares with their best label: ``doc, page, row, side, square_cm, score, labelled``."""
    coincident = (F.size("points") > 2) & (G.distance(F.element_at("points", 1), F.element_at("points", -1)) < 0.3)
    rows = numbered(subpaths).withColumn("side", square_side("points", F.col("closed") | coincident)).where("side IS NOT NULL").withColumn("b", G.bbox("points"))
    t = texts.select("doc", "page", "str", F.col("x").alias("tx"), F.col("y").alias("ty"), X.label_cm("str").alias("cm"))
    near = rows.select("doc", "page", "row", "side", "b").join(t, ["doc", "page"])
    gap = F.hypot(F.greatest(F.col("b.min_x") - F.col("tx"), F.lit(0.0), F.col("tx") - F.col("b.max_x")), F.greatest(F.col("b.min_y") - F.col("ty"), F.lit(0.0), F.col("ty") - F.col("b.max_y")))
    near = near.withColumn("gap", gap).where(F.col("gap") <= F.greatest(F.lit(80.0), F.col("side")))
    named = F.coalesce((F.col("cm") > 0) & (F.col("cm") <= 20), F.lit(False))
    weight = F.when(named, 4).when(F.col("str").rlike("(?i)kontroll|test|kontroln"), 2).otherwise(0)
    near = near.withColumn("score", weight / (1 + F.col("gap") / F.col("side"))).where("score > 0")
    best = near.groupBy("doc", "row").agg(F.max(F.struct("score", F.when(named, F.col("cm")).alias("cm"))).alias("best"))
    rows = rows.join(best, ["doc", "row"], "left").withColumn("physical", F.col("side") * CM_PER_PT)
    standard = F.array_min(F.transform(F.array(*map(F.lit, STANDARD_SIDES_CM)), lambda s: F.struct(F.abs(s - F.col("physical")).alias("d"), s.alias("s"))))["s"]
    rows = rows.withColumn("standard", standard).withColumn("snap", F.abs(F.col("physical") / F.col("standard") - 1) <= 0.03)
    rows = rows.where(F.col("snap") | F.col("best").isNotNull())
    return rows.select(
        "doc", "page", "row", "side", F.coalesce("best.cm", F.when(F.col("snap"), F.col("standard")).otherwise(F.col("physical"))).alias("square_cm"),
        (F.coalesce("best.score", F.lit(0.0)) + F.when(F.col("snap"), 0.5).otherwise(0.0)).alias("score"), F.col("best.cm").isNotNull().alias("labelled"))


def detect_scale(pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc, cm_per_pt, source, square_cm, measured_pt``: the best square of each document, else the print's nominal scale."""
    best = Window.partitionBy("doc").orderBy(F.desc("score"), "row")
    top = candidates.withColumn("r", F.row_number().over(best)).where("r = 1")
    out = pages.select("doc").distinct().join(top, "doc", "left")
    return out.select("doc", F.coalesce(F.col("square_cm") / F.col("side"), F.lit(CM_PER_PT)).alias("cm_per_pt"), F.when(F.col("side").isNull(), "default").otherwise("square").alias("source"), "square_cm", F.col("side").alias("measured_pt"))


def without_scale_marks(subpaths: DataFrame, candidates: DataFrame, scales: DataFrame) -> DataFrame:
    """Subpaths without labelled squares and copies of the square that set the scale."""
    marks = candidates.join(scales.select("doc", "measured_pt"), "doc").where(F.col("labelled") | (F.abs(F.col("side") - F.col("measured_pt")) < 0.5)).select("doc", "row")
    return numbered(subpaths).join(marks, ["doc", "row"], "left_anti")


def merge_spans(rows: DataFrame, keys: list[str], start: str = "a", end: str = "b") -> DataFrame:
    """Overlapping and touching half-open intervals of each key joined: islands by a running maximum."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(order)).groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def upper_median(column: Column | str) -> Column:
    """Grouped: the element at half the count, from the lower end."""
    values = F.array_sort(F.collect_list(column))
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def group_by_overlap(rings: DataFrame, references: DataFrame, overlap, cell: float | None = None) -> DataFrame:
    """``ring, ref, shared``: each ring's reference with the largest shared area, if that is half of the smaller one at least.

    ``overlap`` is a column function of both outlines.  Boxes are listed in all
    grid cells that they cover and joined by cell; a pair counts in the cell of
    its common lower corner only.  A cell is as wide as the widest side of half
    the references, unless ``cell`` says otherwise.
    """
    # equal outlines share their reference, so each is compared once; of equal references the smallest counts
    r = rings.select(F.col("outline").alias("o1")).distinct().select("o1", G.bbox("o1").alias("b1"), G.area("o1").alias("a1"))
    s = references.groupBy(F.col("outline").alias("o2")).agg(F.min("id").alias("ref")).select("ref", "o2", G.bbox("o2").alias("b2"), G.area("o2").alias("a2"))
    if cell is None:
        cell = s.agg(F.percentile_approx(F.greatest("b2.width", "b2.height"), 0.5)).first()[0] or 1.0

    def listed(rows: DataFrame, box: str) -> DataFrame:
        for c in "xy":
            rows = rows.withColumn("c" + c, F.explode(F.sequence(F.floor(F.col(f"{box}.min_{c}") / cell), F.floor(F.col(f"{box}.max_{c}") / cell))))
        return rows

    near = listed(r, "b1").join(dealt(listed(s, "b2")), ["cx", "cy"]).where((F.col("b1.max_x") >= F.col("b2.min_x")) & (F.col("b2.max_x") >= F.col("b1.min_x")) & (F.col("b1.max_y") >= F.col("b2.min_y")) & (F.col("b2.max_y") >= F.col("b1.min_y")))
    corner = [F.floor(F.greatest(f"b1.min_{c}", f"b2.min_{c}") / cell) == F.col("c" + c) for c in "xy"]
    # the boxes' common part bounds the shared area, so most pairs need no exact one
    common = [F.least(f"b1.max_{c}", f"b2.max_{c}") - F.greatest(f"b1.min_{c}", f"b2.min_{c}") for c in "xy"]
    near = near.where(corner[0] & corner[1] & (common[0] * common[1] >= 0.5 * F.least("a1", "a2"))).withColumn("shared", overlap("o1", "o2")).where((F.col("shared") > 0) & (F.col("shared") / F.least("a1", "a2") >= 0.5))
    best = near.groupBy("o1").agg(F.min(F.struct((-F.col("shared")).alias("less"), "ref")).alias("best"))
    best = rings.select(F.col("id").alias("ring"), F.col("outline").alias("o1")).join(dealt(best), "o1").groupBy("ring").agg(F.min("best").alias("best"))
    return best.select("ring", "best.ref", (-F.col("best.less")).alias("shared"))


def segments(subpaths: DataFrame) -> DataFrame:
    """``doc, page, owner, a, b`` of every stroke and fill, with the closing one of closed subpaths."""
    n = F.size("points")
    last = n - F.when(F.col("closed") & (n > 2), 0).otherwise(1)
    rows = subpaths.where(n >= 2).withColumn("i", F.explode(F.sequence(F.lit(0), last - 1)))
    return rows.select("doc", "page", F.col("style").alias("owner"), F.get("points", F.col("i")).alias("a"), F.get("points", (F.col("i") + 1) % n).alias("b"))


def nearest_segment(taps: DataFrame, rows: DataFrame, cell: float = 20.0) -> DataFrame:
    """``tap, owner, distance``: the nearest segment within each tap's tolerance, by a grid of cells.

    ``taps(tap, doc, x, y, tolerance)`` on the sheet of ``doc``.  Segments are listed in the cells of points
    sampled along them, half a cell apart; a tap looks into all cells within its
    tolerance and half a cell.
    """
    steps = F.greatest(F.lit(1), F.ceil(G.distance(F.col("a"), F.col("b")) / (cell / 2))).cast("int")
    samples = F.transform(F.sequence(F.lit(0), steps), lambda k: F.struct(*(F.floor((F.col("a")[i] + (F.col("b")[i] - F.col("a")[i]) * k / steps) / cell).alias(c) for i, c in enumerate(("cx", "cy")))))
    # equal taps and equal segments are one
    listed = rows.select("doc", "owner", "a", "b").distinct().withColumn("c", F.explode(F.array_distinct(samples))).select("doc", "owner", "a", "b", "c.cx", "c.cy")
    reach = F.col("tolerance") + cell / 2
    spot = ["doc", "x", "y", "tolerance"]
    around = taps.select(*spot).distinct().withColumn("cx", F.explode(F.sequence(F.floor((F.col("x") - reach) / cell), F.floor((F.col("x") + reach) / cell)))).withColumn(
        "cy", F.explode(F.sequence(F.floor((F.col("y") - reach) / cell), F.floor((F.col("y") + reach) / cell))))
    near = around.join(dealt(listed), ["doc", "cx", "cy"]).withColumn("distance", G.point_segment_distance(F.array("x", "y"), F.col("a"), F.col("b"))).where(F.col("distance") <= F.col("tolerance"))
    best = near.groupBy(*spot).agg(F.min(F.struct("distance", "owner")).alias("m"))
    return taps.join(dealt(best), spot).groupBy("tap").agg(F.min("m").alias("m")).select("tap", "m.owner", "m.distance")
