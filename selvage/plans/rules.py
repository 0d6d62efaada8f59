"""More registered queries: scalar rules, kernels, answers, orders, seams and cells over the derived fixtures, each with SQL."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.functions import kernels as K
from selvage.functions import text as X
from selvage.functions import view as W
from selvage.operators import answers as A
from selvage.operators import building as B
from selvage.operators import cells as C
from selvage.operators import layout as Y
from selvage.operators import patterns as N
from selvage.operators import prepare as P
from selvage.operators import seams as E
from selvage.operators import summary as M
from selvage.plans import derived as D
from selvage.plans.registry import _EDGES, R6, _with, query, r6
from selvage.sources import documents as J

_CORNERS = """
, c AS (
    SELECT *, outline[2][1] AS x2, outline[2][2] AS y2, outline[3][1] AS x3, outline[3][2] AS y3, outline[4][1] AS x4, outline[4][2] AS y4, outline[len(outline)][1] AS xl, outline[len(outline)][2] AS yl FROM d_ring
)"""
_CROSS = "(({b0} - {a0}) * ({c1} - {a1}) - ({b1} - {a1}) * ({c0} - {a0}))"


def _cross(a: str, b: str, c: str) -> str:
    at = {"1": ("0", "0"), "2": ("x2", "y2"), "3": ("x3", "y3"), "4": ("x4", "y4")}
    return _CROSS.format(a0=at[a][0], a1=at[a][1], b0=at[b][0], b1=at[b][1], c0=at[c][0], c1=at[c][1])


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.pieces(spark, sf_dir)
    return rows.select("*", *(F.element_at("outline", k).alias(f"p{k}") for k in (1, 2, 3, 4)), F.element_at("outline", -1).alias("pl"))


@query(_with(D.PIECES_SQL, tail=_CORNERS + f"""
SELECT piece_id, {R6.format('w + 3')} AS moved_right, {R6.format('h')} AS flipped_top, {R6.format(_cross('1', '2', '3'))} AS turn,
    {R6.format('abs(' + _cross('2', '3', '1') + ') / sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2)')} AS from_line,
    {R6.format('fmod(degrees(atan2(y3 - y2, x3 - x2)) + 360, 180)')} AS angle,
    {R6.format('least(fmod(abs(fmod(degrees(atan2(y3 - y2, x3 - x2)) + 360, 180) - 10), 180), 180 - fmod(abs(fmod(degrees(atan2(y3 - y2, x3 - x2)) + 360, 180) - 10), 180))')} AS gap,
    abs(x3 - x2) <= abs(y3 - y2) * tan(pi() / 180) + 1e-8 AS upright,
    {R6.format('2 * (x3 + 3 * y3 + 5) - (2 * x3 + 4 * y3 + 6) + 4')} AS mapped_x, {R6.format('0.5 * (x3 + 3 * y3 + 5) + 3 * (2 * x3 + 4 * y3 + 6) + 5')} AS mapped_y,
    {R6.format('(3 * x2 + 3 * x3 + x4) / 8')} AS curve_x, {R6.format('(3 * y2 + 3 * y3 + y4) / 8')} AS curve_y,
    {R6.format('1.5 * 6 / (6 * sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) / sqrt(9 * (x3 - x2) ** 2 + 4 * (y3 - y2) ** 2))')} AS stroke_width,
    {R6.format('2 * (x2 + t * (x3 - x2))')} AS mirror_x, {R6.format('2 * (y2 + t * (y3 - y2))')} AS mirror_y, CAST(len(outline) AS INTEGER) AS opened,
    (greatest(0, x3) >= least(x2, x4) - 1e-8 AND greatest(x2, x4) >= least(0, x3) - 1e-8 AND greatest(0, y3) >= least(y2, y4) - 1e-8 AND greatest(y2, y4) >= least(0, y3) - 1e-8)
        AND {_cross('1', '3', '2')} * {_cross('1', '3', '4')} <= 0 AND {_cross('2', '4', '1')} * {_cross('2', '4', '3')} <= 0 AS diagonals_meet, true AS same
FROM (SELECT *, ((0 - x2) * (x3 - x2) + (0 - y2) * (y3 - y2)) / ((x3 - x2) ** 2 + (y3 - y2) ** 2) AS t FROM c)"""))
def corner_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """translate, mirror_y, cross, line_distance, axis_angle, angle_gap, fold_is_vertical, affine (point) and its product, bezier, stroke_metrics, mirror_across, open_ring, segments_intersect, same_outline."""
    p1, p2, p3, p4 = (F.col(f"p{k}") for k in (1, 2, 3, 4))
    m, n = (F.array(*map(F.lit, map(float, v))) for v in ((2, 0.5, -1, 3, 4, 5), (1, 2, 3, 4, 5, 6)))
    rows = _corners(spark, sf_dir).withColumn("to", G.affine(G.affine_product(m, n), p3[0], p3[1])).withColumn("mid", F.element_at(G.bezier(p1, p2, p3, p4), 6)).withColumn("mir", F.element_at(G.mirror_across("outline", p2, p3), 1))
    ctm = F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 0.0, 0.0)))
    angle = G.axis_angle(p2, p3)
    return rows.select(
        "piece_id", r6(G.bbox(G.translate("outline", 3, -2))["max_x"]).alias("moved_right"), r6(F.element_at(G.mirror_y("outline"), 1)[1]).alias("flipped_top"), r6(G.cross(p1, p2, p3)).alias("turn"),
        r6(G.line_distance(p1, p2, p3)).alias("from_line"), r6(angle).alias("angle"), r6(G.angle_gap(angle, F.lit(10.0))).alias("gap"), G.fold_is_vertical(p2, p3).alias("upright"),
        r6(F.col("to")[0]).alias("mapped_x"), r6(F.col("to")[1]).alias("mapped_y"), r6(F.col("mid")[0]).alias("curve_x"), r6(F.col("mid")[1]).alias("curve_y"),
        r6(G.stroke_metrics(ctm, F.lit(1.5), p2, p3)["line_width"]).alias("stroke_width"), r6(F.col("mir")[0]).alias("mirror_x"), r6(F.col("mir")[1]).alias("mirror_y"),
        F.size(G.open_ring(F.concat("outline", F.array(p1)))).alias("opened"), G.segments_intersect(p1, p3, p2, p4).alias("diagonals_meet"), G.same_outline("outline", G.translate("outline", 0.05, 0), 0.1).alias("same"))


@query(_with(D.PIECES_SQL, tail=_CORNERS + """
, e AS (SELECT piece_id, x3, y3, unnest(outline) AS p FROM c), s AS (SELECT piece_id, (x3 * p[2] - y3 * p[1]) / sqrt(x3 * x3 + y3 * y3) AS d FROM e)
SELECT piece_id, max(d) <= 0.2 OR min(d) >= -0.2 AS one_sided FROM s GROUP BY piece_id"""))
def one_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corners(spark, sf_dir).select("piece_id", G.one_sided("outline", F.col("p1"), F.col("p3"), 0.2).alias("one_sided"))


_AREA = ", own AS (SELECT piece_id, abs(sum(a[1] * b[2] - b[1] * a[2])) / 2 AS area, sum(sqrt((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2)) AS around FROM d_edge GROUP BY piece_id)"


@lru_cache(maxsize=4096)
def _kernels(outline: tuple) -> tuple:
    """Results of all kernels for one outline; equal outlines share them."""
    r = list(outline)
    w = max(x for x, _ in r)
    dense = [p for a, b in zip(r, r[1:] + r[:1]) for p in (a, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2))]
    return (
        abs(K.signed_area(K.offset(r, 1.0))), abs(K.signed_area(K.unfold(r, r[0], r[-1]))), K.is_simple(r), K.polygon_distance(r, [(x + w + 3, y) for x, y in r]),
        abs(K.signed_area(K.union(r, [(x + w / 2, y) for x, y in r]))), abs(K.signed_area(K.clip_right([(x - w / 2, y) for x, y in r]))), len(K.simplify([*dense, dense[0]], 0.01)) - 1)


@query(_with(D.PIECES_SQL, tail=_EDGES + _AREA + """
SELECT own.piece_id, CASE WHEN shape <> 1 THEN floor((area + around + 4) * 1e3 + 0.5) / 1e3 END AS grown, floor(2 * area * 1e3 + 0.5) / 1e3 AS unfolded, true AS simple, 3e0 AS apart,
    CASE shape WHEN 2 THEN floor(1.5 * w * h * 1e3 + 0.5) / 1e3 END AS joined, CASE shape WHEN 2 THEN floor(w * h / 2 * 1e3 + 0.5) / 1e3 END AS clipped, CASE shape WHEN 0 THEN 6 ELSE 4 END AS points
FROM own JOIN d_piece ON d_piece.piece_id = own.piece_id"""))
def polygon_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """offset by 1 cm, unfold at the first and last point, is_simple, polygon_distance to a copy 3 cm further, union with a copy half as wide away, clip_right, simplify."""
    def run(outline: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_kernels(tuple(K.as_ring(r))) for r in outline], columns=["grown", "unfolded", "simple", "apart", "joined", "clipped", "points"])

    got = D.pieces(spark, sf_dir).select("piece_id", "shape", F.pandas_udf(run, "grown double, unfolded double, simple boolean, apart double, joined double, clipped double, points int")("outline").alias("k"))
    return got.select(
        "piece_id", F.when(F.col("shape") != 1, G.js_round(F.col("k.grown"), 3)).alias("grown"), G.js_round(F.col("k.unfolded"), 3).alias("unfolded"), "k.simple", G.js_round(F.col("k.apart"), 3).alias("apart"),
        *(F.when(F.col("shape") == 2, G.js_round(F.col("k." + c), 3)).alias(c) for c in ("joined", "clipped")), "k.points")


@query("""
SELECT p_partkey AS k, floor(p_size / 2.54e0 * 1e6 + 0.5) / 1e6 AS inches, 'dil-' || p_partkey || '-a' AS slug, 'My Pattern ' || p_partkey AS name,
    CASE WHEN p_size <= 38 THEN p_size || ',38' ELSE '38,' || p_size END || ',S,XL' AS sorted, CASE WHEN p_partkey % 2 = 0 THEN '34' ELSE '34, 36, 38' END AS toggled,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Size ' || p_size END AS typed, CAST(p_size AS VARCHAR) AS named,
    CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE floor(p_size * 2.54e0 * 1e6 + 0.5) / 1e6 END AS side, floor((p_size + cos(0.5e0) * 11 * 8 * 0.25) * 1e6 + 0.5) / 1e6 AS centre, p_partkey % 2 = 1 AS is_table
FROM part""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """to_unit, slug, pattern_name, sort_sizes, toggle_size, parse_size_name, named_sizes, label_cm, text_centre, table_like."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    even = k % 2 == 0
    order = F.array(*map(F.lit, ("34", "36", "38")))
    rows = D.table(spark, sf_dir, "part")
    return rows.select(
        k.alias("k"), r6(X.to_unit(F.col("p_size").cast("double"), "in")).alias("inches"), X.slug(F.concat(F.lit("Díl "), k.cast("string"), F.lit(" – Ä"))).alias("slug"),
        X.pattern_name(F.when(even, "draft.indd"), F.concat(F.lit("My_Pattern-"), k.cast("string"), F.lit("_A4_print.pdf"))).alias("name"),
        F.array_join(X.sort_sizes(F.array(F.lit("XL"), F.lit("38"), F.lit("S"), size)), ",").alias("sorted"),
        X.toggle_size(F.when(even, "34, 36").otherwise("34, 36"), F.when(even, "36").otherwise("38"), order).alias("toggled"),
        X.parse_size_name(F.when(k % 3 == 0, "34,36").otherwise(F.concat(F.lit("  Size   "), size))).alias("typed"), F.array_join(X.named_sizes(F.concat(F.lit("uni; "), size)), ",").alias("named"),
        r6(X.label_cm(F.concat(F.lit("Test "), size, F.when(even, " cm").otherwise(" inch")))).alias("side"),
        r6(X.text_centre(F.col("p_size").cast("double"), F.lit(0.0), F.lit(0.5), F.lit(8.0), F.lit("eleven char"))[0]).alias("centre"),
        X.table_like(F.array(F.lit("34 36"), F.when(even, "Sleeve").otherwise("M"), F.lit("Front"), F.when(even, "Back").otherwise("40"))).alias("is_table"))


@query("""
SELECT p_partkey AS k, CASE WHEN row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1 THEN 's' || p_size ELSE 's' || p_size || '-' || row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) END AS id FROM part""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("base"))
    return rows.select("k", X.unique_ids("base", order="k").alias("id"))


_VIEW = """
WITH v AS (
    SELECT p_partkey AS k, 100e0 + p_partkey % 700 AS sw, 200e0 + p_partkey % 900 AS sh, 400e0 AS bw, 300e0 AS bh, 0.5e0 + p_partkey % 5 AS s, -(p_partkey % 50) * 1e0 AS x, p_partkey % 30 * 1e0 AS y FROM part
), l AS (SELECT *, least(bw / sw, bh / sh) AS fit FROM v), z AS (SELECT *, greatest(4 * fit, 12) AS top FROM l),
m AS (SELECT *, least(top, greatest(fit, s)) AS cs, least(top, greatest(fit, s * 2)) AS zs FROM z), q AS (SELECT *, 200 - (200 - x) * (zs / s) AS zx, 150 - (150 - y) * (zs / s) AS zy FROM m)"""


@query(_VIEW + f"""
SELECT k, {R6.format('fit')} AS fit, {R6.format('top')} AS top, {R6.format('(bw - sw * fit) / 2')} AS fit_x, {R6.format('(bh - sh * fit) / 2')} AS fit_y,
    {R6.format('cs')} AS clamp_scale, {R6.format('CASE WHEN sw * cs <= bw THEN (bw - sw * cs) / 2 ELSE least(0, greatest(bw - sw * cs, x)) END')} AS clamp_x,
    {R6.format('zs')} AS zoom_scale, {R6.format('CASE WHEN sh * zs <= bh THEN (bh - sh * zs) / 2 ELSE least(0, greatest(bh - sh * zs, zy)) END')} AS zoom_y,
    {R6.format('(100 - x) / s + 7')} AS sheet_x, sqrt(x * x + y * y) <= 6 AS tap,
    'rgb(' || CASE WHEN k % 2 = 0 THEN CAST(floor((k % 11 / 10e0 + (1 - greatest(k % 11 / 10e0, 0.2e0) - least(k % 11 / 10e0, 0.2e0))) * 255 + 0.5) AS BIGINT) || ',' || CAST(floor((0.2e0 + (1 - greatest(k % 11 / 10e0, 0.2e0) - least(k % 11 / 10e0, 0.2e0))) * 255 + 0.5) AS BIGINT)
        ELSE CAST(floor(k % 11 / 10e0 * 255 + 0.5) AS BIGINT) || ',51' END || ')' AS ink,
    'oklch(var(--size-l) var(--size-c) ' || CASE WHEN k % 2 = 0 THEN CAST(CAST(fmod(k * 137.5e0 + 250, 360) AS BIGINT) AS VARCHAR) ELSE CAST(fmod(k * 137.5e0 + 250, 360) AS VARCHAR) END || ')' AS hue, '<g a="' || k || '" b=""/>' AS markup
FROM q""")
def view_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scale_limits, fit_view, clamp_view, zoom_view, screen_to_sheet, is_tap, ink_color, size_color, inline_tokens."""
    k = F.col("p_partkey").cast("long")
    rows = D.table(spark, sf_dir, "part").select(
        k.alias("k"), F.struct((100.0 + k % 700).alias("width"), (200.0 + k % 900).alias("height")).alias("sheet"), F.struct(F.lit(400.0).alias("width"), F.lit(300.0).alias("height")).alias("box"),
        F.struct((0.5 + k % 5).alias("scale"), (-(k % 50)).cast("double").alias("x"), (k % 30).cast("double").alias("y")).alias("view"), F.array((k % 11) / 10.0, F.lit(0.2)).alias("rgb"))
    s, b, v = F.col("sheet"), F.col("box"), F.col("view")
    fit, clamped, zoomed = W.fit_view(s, b), W.clamp_view(v, s, b), W.zoom_view(v, F.lit(2.0), F.array(F.lit(200.0), F.lit(150.0)), s, b)
    return rows.select(
        "k", r6(fit["scale"]).alias("fit"), r6(W.scale_limits(s, b)["most"]).alias("top"), r6(fit["x"]).alias("fit_x"), r6(fit["y"]).alias("fit_y"), r6(clamped["scale"]).alias("clamp_scale"), r6(clamped["x"]).alias("clamp_x"),
        r6(zoomed["scale"]).alias("zoom_scale"), r6(zoomed["y"]).alias("zoom_y"), r6(W.screen_to_sheet(v, F.lit(7.0), F.lit(0.0), F.array(F.lit(100.0), F.lit(0.0)))[0]).alias("sheet_x"), W.is_tap(v["x"], v["y"]).alias("tap"),
        W.ink_color(F.col("rgb"), F.col("k") % 2 == 0).alias("ink"), W.size_color(F.col("k")).alias("hue"), W.inline_tokens(F.concat(F.lit('<g a="'), F.lit("var(--k)"), F.col("k").cast("string"), F.lit('" b="var(--none)"/>')), {"--k": ""}).alias("markup"))


@query(_with(D.PIECES_SQL, tail=f"""
, m AS (SELECT *, h / 2 AS y FROM d_piece)
SELECT piece_id, {R6.format("CASE shape WHEN 0 THEN CASE WHEN 0.4 * h > h / 2 THEN w / 2 ELSE 0.2 * w END WHEN 1 THEN (0.15 * w / 2 + (w + 0.8 * w) / 2) / 2 ELSE w / 2 END")} AS x, {R6.format('y')} AS y FROM m"""))
def label_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the height of an L lies above its foot, so the label stands in its arm."""
    p = W.label_point("outline")
    return D.pieces(spark, sf_dir).select("piece_id", r6(p[0]).alias("x"), r6(p[1]).alias("y"))


@query("""
WITH RECURSIVE v AS (SELECT DISTINCT l_orderkey AS run_id, floor(l_extendedprice / 1000e0 * 10 + 0.5) / 10 AS v FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY v) AS i FROM v),
w AS (SELECT run_id, i, v, v AS last, true AS label FROM n WHERE i = 1
    UNION ALL SELECT n.run_id, n.i, n.v, CASE WHEN n.v - w.last >= 5 THEN n.v ELSE w.last END, n.v - w.last >= 5 FROM w JOIN n ON n.run_id = w.run_id AND n.i = w.i + 1)
SELECT run_id, v, label FROM w""")
def ruler_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of an order along a ruler, labelled where the last label is five units away."""
    rows = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.collect_list(F.col("l_extendedprice").cast("double") / 1000).alias("v"))
    return rows.select("run_id", F.explode(W.breakpoints("v", 5.0)).alias("b")).select("run_id", "b.v", "b.label")


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 9 <= 6 AND p_size > 3 THEN p_size % 9 + 0.5e0 * (p_size % 9 < 6)::INT END AS gap,
    CASE p_partkey % 4 WHEN 0 THEN floor(2.54e0 / 72 * p_size / 100 * 1e9 + 0.5) / 1e9 WHEN 1 THEN floor(5e0 / 140 * 1e9 + 0.5) / 1e9 WHEN 2 THEN floor(p_size / 140e0 * 1e9 + 0.5) / 1e9 END AS cm_per_pt,
    CASE WHEN p_partkey % 4 = 3 THEN 'scale.squareMissing' END AS error,
    CASE p_partkey % 5 WHEN 0 THEN 'name' WHEN 1 THEN 'material' WHEN 2 THEN 'count,variantName,variantEmpty:2' WHEN 3 THEN 'variantUnique,variantSplit:a' ELSE '' END AS problems
FROM part""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse of trace options, override_scale and resolve_scale, draft_problems."""
    k, size = F.col("p_partkey"), F.col("p_size")
    g = size % 9
    gap = F.concat(g.cast("string"), F.when(g < 6, ",5").otherwise(""))
    options = A.trace_options(gap, F.when(size > 3, " 0,5 ").otherwise("2"), F.lit("15"))
    square = k % 4 != 3
    scale = F.struct(F.lit(5.0 / 140).alias("cm_per_pt"), F.when(square, "square").otherwise("default").alias("source"), F.when(square, 5.0).alias("square_cm"), F.when(square, 140.0).alias("measured_pt"))
    got = A.resolve_scale(scale, k % 4 == 1, size.cast("double"), F.when(k % 4 == 0, size.cast("double")))
    m = k % 5
    cut = F.when(m == 1, F.expr("CAST(array() AS array<struct<material:string,count:double>>)")).otherwise(F.array(F.struct(F.lit("main").alias("material"), F.when(m == 2, 0.0).otherwise(2.0).alias("count"))))

    def variant(label, ids: str, split) -> F.Column:
        return F.struct(label.alias("label"), F.create_map(F.lit("uni"), F.expr(ids)).alias("cells"), split.alias("split"))

    no = F.lit(False)
    variants = F.when(m == 2, F.array(variant(F.lit("a"), "array(1)", no), variant(F.lit(" "), "CAST(array() AS array<int>)", no))).when(
        m == 3, F.array(variant(F.lit("a"), "array(1, 2)", F.lit(True)), variant(F.lit(" A"), "array(2)", no))).otherwise(F.array(variant(F.lit("x"), "array(1)", no)))
    rows = D.table(spark, sf_dir, "part").select(k.alias("k"), options.alias("o"), got.alias("s"), A.draft_problems(F.when(m == 0, " ").otherwise("Front"), cut, F.lit(90.0), variants).alias("p"))
    return rows.select("k", "o.gap_mm", G.js_round(F.col("s.scale.cm_per_pt"), 9).alias("cm_per_pt"), "s.error", F.array_join("p", ",").alias("problems")).withColumnRenamed("gap_mm", "gap")


@query("""
SELECT s_suppkey AS doc, CASE s_suppkey % 3 WHEN 0 THEN '34,36,38,40' WHEN 1 THEN 'S,M,L' ELSE '92,98' END AS sizes FROM supplier""")
def size_legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A legend in a row, a column of letters, or a pair, beside single numbers and measurements elsewhere."""
    doc = F.col("s_suppkey")
    def texts_at(*rows: tuple[str, float, float]) -> F.Column:
        return F.array(*(F.struct(F.lit(t).alias("str"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in rows))

    legend = F.when(doc % 3 == 0, texts_at(("40", 0.0, 0.0), ("Sizes: 34 36", 60.0, 1.0), ("38", 20.0, 0.0))).when(
        doc % 3 == 1, texts_at(("L", 0.0, 0.0), ("m", 2.0, 15.0), ("S", 1.0, 30.0))).otherwise(texts_at(("Größe 98, 92", 0.0, 0.0)))
    other = texts_at(("7", 500.0, 500.0), ("2.5", 10.0, 3.0), ("Front", 5.0, 2.0), ("200", 30.0, 1.0), ("44", 500.0, 900.0))
    texts = D.table(spark, sf_dir, "supplier").select(doc.cast("long").alias("doc"), F.lit(1).alias("page"), F.explode(F.concat(legend, other)).alias("t")).select("doc", "page", "t.*", F.lit(8.0).alias("height"))
    return A.size_chips(texts).select("doc", F.array_join("sizes", ",").alias("sizes"))


@query("""
WITH c AS (SELECT l_suppkey AS doc, CAST(l_quantity AS BIGINT) AS cells, l_extendedprice AS area FROM lineitem)
SELECT doc, CASE WHEN max(cells * 61 // 50) > 60 OR sum(CASE WHEN cells * 61 // 50 > 30 THEN area ELSE 0 END) >= 0.5 * sum(area) THEN 'overlapping' END AS problem FROM c GROUP BY doc""")
def sheet_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_partkey").alias("candidate"), F.col("l_extendedprice").cast("double").alias("outline_cm2"), F.floor(F.col("l_quantity").cast("long") * 61 / 50).alias("cells"))
    return A.sheet_problem(rows)


@query("""
SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'fill:1,0,0:0:' ELSE 'stroke:0,0,0.502:' || CASE WHEN p_partkey % 3 = 1 THEN '1.5' ELSE '2' END || ':6,4' END AS key FROM part""")
def style_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes under a matrix that is twice as wide: lines along x keep their width times the height's scale."""
    i = F.col("p_partkey").cast("long")
    fill = i % 3 == 0
    points = F.when(i % 3 == 1, F.expr("array(array(0D, 0D), array(10D, 0D))")).otherwise(F.expr("array(array(0D, 0D), array(0D, 10D))"))
    rows = D.table(spark, sf_dir, "part").select(
        (i % 25).alias("doc"), i.alias("path"), F.when(fill, "fill").otherwise("stroke").alias("kind"), F.when(fill, F.expr("array(1D, 0D, 0D)")).otherwise(F.expr("array(0D, 0D, 0.5019D)")).alias("color"), F.lit(1.0).alias("width"),
        F.when(i % 3 == 1, F.expr("array(3D, 2D)")).when(i % 3 == 2, F.expr("array(4D, 2.6666D)")).otherwise(F.expr("array(1D)")).alias("dash"), F.expr("array(2D, 0D, 0D, 1.5D, 0D, 0D)").alias("ctm"), points.alias("points"), F.lit(False).alias("closed"))
    return A.path_style(rows).select("path", "key")


_ORDER = """
WITH l AS (
    SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || CAST(l_quantity AS INTEGER) AS line_id, l_partkey AS p, CAST(l_quantity AS INTEGER) AS q
    FROM lineitem
)"""


def _order(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every part as a pattern of a plain, an optional and two variant pieces; all lines of the retail orders as its order lines."""
    rows = D.pieces(spark, sf_dir)
    shape = F.struct("outline", F.lit(None).cast(G.RING).alias("fold"), F.array("w", "h").alias("bbox"), G.area("outline").alias("area"))
    sizes = F.create_map(F.lit("uni"), shape)
    text = F.lit(None).cast("string")

    def piece(pid: str, cut: dict, optional: bool = False, group: str | None = None) -> F.Column:
        cuts = F.array(*(F.struct(F.lit(m).alias("material"), (n if isinstance(n, F.Column) else F.lit(n)).cast("int").alias("count")) for m, n in cut.items()))
        return F.struct(F.lit(pid).alias("id"), F.lit(pid).alias("name"), cuts.alias("cut"), F.lit(optional).alias("optional"), (F.lit(pid.upper()) if group else text).alias("variant"), (F.lit(group) if group else text).alias("variantGroup"), text.alias("note"), text.alias("seamAllowance"), sizes.alias("sizes"))

    k = F.col("piece_id")
    pieces = F.array(piece("body", {"A": k % 4 + 1, "R": k % 3 + 1}), piece("tab", {"R": 1}, True), piece("v1", {"A": 1}, group="g"), piece("v2", {"N": 3}, group="g"))
    patterns = rows.select(k.cast("string").alias("id"), F.lit("P").alias("name"), F.lit("none").alias("seamAllowance"), F.array(F.lit("uni")).alias("sizes"), pieces.alias("pieces"))
    q = F.col("l_quantity").cast("int")
    flags = F.when(q % 3 == 0, F.expr("map('tab', true)")).when(q % 3 == 1, F.expr("map('v2', true)")).otherwise(F.expr("CAST(map() AS map<string,boolean>)"))
    lines = D.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")), q.cast("string")).alias("line_id"), F.col("l_partkey").cast("string").alias("pattern_id"), F.lit("uni").alias("size"), (q * 3).alias("quantity"), flags.alias("include"),
        F.expr("CAST(map() AS map<string,string>)").alias("rotations"))
    return lines, patterns


@query(_ORDER + """
, c AS (
    SELECT line_id, 'body' AS piece, 'A' AS material, p % 4 + 1 AS n, q FROM l UNION ALL SELECT line_id, 'body', 'R', p % 3 + 1, q FROM l UNION ALL SELECT line_id, 'tab', 'R', 1, q FROM l WHERE q % 3 = 0
    UNION ALL SELECT line_id, 'v2', 'N', 3, q FROM l WHERE q % 3 = 1 UNION ALL SELECT line_id, 'v1', 'A', 1, q FROM l WHERE q % 3 <> 1)
SELECT line_id, piece, material, CAST(sum(CASE WHEN material = 'R' THEN (n + 1) // 2 ELSE n END) AS BIGINT) AS placements, CAST(sum(CASE WHEN material = 'R' THEN q * 3 * (n % 2) ELSE 0 END) AS BIGINT) AS surplus FROM c GROUP BY line_id, piece, material""")
def order_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """included_pieces, variant_choices and prepare's cuts: what every order line cuts from each fabric, doubled where that is folded."""
    lines, patterns = _order(spark, sf_dir)
    cuts = P.cuts(lines, patterns, F.broadcast(D.fabrics(spark)))  # two rows
    # a line's number names its pattern, by which the lines are dealt out already
    summed = cuts.groupBy("pattern_id", "line_id", F.col("piece.id").alias("piece"), "material").agg(F.sum("placements").alias("placements"), F.sum("surplus").alias("surplus"))
    return summed.drop("pattern_id")


@query(_ORDER + """
SELECT line_id, CAST(2 + (q % 3 = 0)::INT AS BIGINT) AS selected, CAST(3 AS BIGINT) AS total FROM l""")
def order_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain piece and one of the variants, and the optional one where it is asked for."""
    got = P.piece_counts(*_order(spark, sf_dir))
    return got.select("line_id", *(F.col(c).cast("long").alias(c) for c in ("selected", "total")))


@query(_ORDER + """
SELECT line_id, 'prepare.quantityRange' AS code FROM l WHERE q * 3 > 100""")
def order_line_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.line_problems(*_order(spark, sf_dir))


@query("""
WITH u AS (SELECT CAST(l_partkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN n > 0 THEN 'delete.withLines' ELSE 'delete.plain' END AS code, coalesce(n, 0) AS n FROM part LEFT JOIN u ON u.id = CAST(p_partkey AS VARCHAR)""")
def delete_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines_using and delete_question for every pattern."""
    lines, patterns = _order(spark, sf_dir)
    return P.delete_question(patterns, lines)


@query(_ORDER + """
SELECT line_id, CASE WHEN q % 3 = 1 THEN 'v1' ELSE CASE WHEN q % 3 = 0 THEN 'tab,v1' ELSE 'v1' END END AS included FROM l""")
def chosen_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """choose_variant: the first variant in every line, whatever it had before."""
    lines, patterns = _order(spark, sf_dir)
    got = P.choose_variant(lines, patterns, "g", "V1")
    return got.select("line_id", F.array_join(F.array_sort(F.map_keys(F.map_filter("include", lambda _, v: v))), ",").alias("included"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS line_id, CAST(p_partkey AS VARCHAR) AS pattern_id, 'uni' AS size, 1 AS quantity FROM part""")
def default_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """make_order: each pattern once, in its first size."""
    return P.default_lines(_order(spark, sf_dir)[1]).select("line_id", "pattern_id", "size", "quantity")


@query("""
SELECT 'M' || p_partkey AS material, CASE WHEN p_size > 40 THEN 'fabric.widthRange' ELSE 'fabric.lengthRange' END AS code FROM part WHERE p_size > 40 OR p_size % 5 = 0""")
def fabric_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "part").select(
        F.concat(F.lit("M"), F.col("p_partkey").cast("string")).alias("material"), (F.col("p_size") * 25.0).alias("width"), F.when(F.col("p_size") % 5 == 0, -1.0).alias("length"))
    return P.check_inputs(P.DEFAULTS, rows.select("material"), rows)


@query("""
WITH v AS (SELECT l_suppkey AS k, CAST(l_partkey % 40 AS DOUBLE) * 3 + (l_linenumber % 2) * 0.5e0 AS pos, l_quantity * 4e0 AS low, l_quantity * 4e0 + l_linenumber AS high FROM lineitem),
p AS (SELECT *, floor(pos / 3) AS spot FROM v), m AS (SELECT *, max(high) OVER (PARTITION BY k, spot ORDER BY low, pos, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach + 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY k, spot ORDER BY low, pos, high ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, floor(sum(pos * (high - low)) / sum(high - low) * 1e6 + 0.5) / 1e6 AS place, min(low) AS low, max(high) AS high FROM g GROUP BY k, spot, island""")
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), ((F.col("l_partkey") % 40).cast("double") * 3 + (F.col("l_linenumber") % 2) * 0.5).alias("at"), (F.col("l_quantity").cast("double") * 4).alias("low"), (F.col("l_quantity").cast("double") * 4 + F.col("l_linenumber")).alias("high"))
    return Y.merged_lines(rows, ["k"]).select("k", r6("at").alias("place"), "low", "high")


def _leaving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Four pages of each supplier: lines leave page n at three places and enter page n + 1 there, on every fifth sheet with another slope."""
    doc = F.col("s_suppkey").cast("long")
    base = D.table(spark, sf_dir, "supplier").select(doc.alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    out_y, in_y = 40.0 + F.col("n") * 60 + F.col("page") * 11, 40.0 + F.col("n") * 60 + (F.col("page") - 1) * 11
    bend = F.when(F.col("doc") % 5 == 0, 20.0).otherwise(0.0)
    ends = F.array(F.struct((F.col("n") * 2).alias("i"), F.array(F.lit(150.0), out_y).alias("a"), F.array(F.lit(200.0), out_y).alias("b")), F.struct((F.col("n") * 2 + 1).alias("i"), F.array(F.lit(0.0), in_y).alias("a"), F.array(F.lit(60.0), in_y + bend).alias("b")))
    segments = base.select("doc", "page", F.explode(ends).alias("s")).select("doc", "page", "s.*")
    return segments, base.select("doc", "page").distinct().select("doc", "page", F.lit(200.0).alias("width"), F.lit(300.0).alias("height"))


@query("""
SELECT CAST(s_suppkey AS BIGINT) AS doc, 0 AS axis, CAST(p AS INTEGER) AS a, CAST(p + 1 AS INTEGER) AS b, 3 AS votes FROM supplier, (SELECT unnest(range(1, 4)) AS p) WHERE s_suppkey % 5 <> 0""")
def edge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """crossings, compare_crossings, seam and edge matches: each page continues on the next."""
    return E.edge_matches(*_leaving(spark, sf_dir))


@query(_with(D.PIECES_SQL, tail="""
SELECT piece_id, 's' AS size, CAST(1 AS BIGINT) AS id, CAST(CASE WHEN piece_id % 2 = 0 THEN 7 ELSE 9 END AS BIGINT) AS other FROM d_piece"""))
def mapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two cells of another size the one that covers more of the piece."""
    rows = D.pieces(spark, sf_dir)
    outline = F.col("piece_id").cast("string").alias("outline")
    chosen = rows.select(outline, F.lit(1).cast("long").alias("id"), F.col("outline").alias("ring"))
    near = F.when(F.col("piece_id") % 2 == 0, F.col("w") * 0.1).otherwise(F.col("w") * 0.3)
    two = F.array(F.struct(F.lit(7).cast("long").alias("id"), near.alias("dx")), F.struct(F.lit(9).cast("long").alias("id"), (F.col("w") * 0.2).alias("dx")), F.struct(F.lit(11).cast("long").alias("id"), (F.col("w") * 5).alias("dx")))
    other = rows.select(F.col("piece_id").cast("string").alias("key"), F.lit("s").alias("size"), F.col("outline").alias("ring"), F.explode(two).alias("c")).select(F.col("key").alias("outline"), "size", "c.id", G.translate("ring", F.col("c.dx"), 0.0).alias("ring"))
    got = C.map_cells(chosen, other, M.intersection_area)
    return got.select(F.col("outline").cast("long").alias("piece_id"), "size", "id", "other")


@query(_with(D.PIECES_SQL, tail=f"""
SELECT piece_id, {R6.format('2 * w * h + 0.06 * (4 * w + 2 * h) + 4 * 0.06 * 0.06')} AS area FROM d_piece"""))
def united_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """single_cell and union_cells: each piece's rectangle and its neighbour, grown by 0.6 of a pixel of 1 mm."""
    rows = D.pieces(spark, sf_dir).withColumn("outline", D.rectangle(F.col("w"), F.col("h")))
    first = rows.select(F.col("piece_id").cast("string").alias("outline"), F.col("outline").alias("ring"), "w")
    one = C.single_cell(first)
    two = first.select("outline", F.lit(2).cast("long").alias("id"), G.translate("ring", F.col("w"), 0.0).alias("ring"))
    got = C.union_cells(one.select("outline", "id", "ring").union(two), cm_per_pt=1.0, pixel_mm=1.0)
    return got.select(F.col("outline").cast("long").alias("piece_id"), r6(G.area("ring")).alias("area"))


@query("""
WITH v AS (SELECT s_suppkey AS k, unnest(range(1, 4 + s_suppkey % 4)) AS variant FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT CAST(k AS VARCHAR) AS piece, CAST(variant AS INTEGER) AS variant, 'Option ' || variant AS label, s AS size, CAST(variant AS INTEGER) AS cells FROM v, (VALUES ('34'), ('36')) t(s)""")
def chain_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """propose_chain: a chain of cells for each supplier in two sizes; every fifth has one cell more in the second size."""
    k, longer = F.col("s_suppkey"), (F.col("s_suppkey") % 5 == 0) & (F.col("size") == "36")
    base = D.table(spark, sf_dir, "supplier").select(k, F.explode(F.array(F.lit("34"), F.lit("36"))).alias("size")).withColumn("n", 3 + k % 4 + F.when(longer, 1).otherwise(0))
    each = base.select(F.concat_ws("\0", k.cast("string"), "size").alias("outline"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("id"), "n")
    cells = each.select("outline", "id", (F.lit(100.0) - F.col("id")).alias("area"))
    borders = each.where("id < n").select("outline", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(10.0).alias("shared"))
    got = C.propose_chain(cells, borders.union(borders.select("outline", F.col("b").alias("a"), F.col("a").alias("b"), "shared")), 1.0)
    return got.select("piece", "variant", "label", "size", F.size("cells").alias("cells"))


@query("""
SELECT CAST(s_suppkey AS VARCHAR) AS outline, CAST(l AS INTEGER) AS level, floor(l * 100e0 + (20 + 20 * l) * 0.06 + 4 * 0.0036 + 0.5) AS area FROM supplier, (VALUES (1), (2), (3)) t(l) WHERE s_suppkey % 5 <> 0
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 0, NULL FROM supplier WHERE s_suppkey % 5 = 0""")
def nested_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nested_outlines: three squares in a row as three sizes; every fifth supplier has a single cell."""
    k = F.col("s_suppkey")
    base = D.table(spark, sf_dir, "supplier").select(k.cast("string").alias("outline"), F.when(k % 5 == 0, 1).otherwise(3).cast("long").alias("n"))
    each = base.select("outline", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("id"))
    x = (F.col("id") - 1) * 10.0
    ring = F.array(*(F.array(x + a, F.lit(b)) for a, b in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))))
    cells = each.select("outline", "id", F.lit(100.0).alias("area"), ring.alias("ring"))
    borders = each.where("id < n").select("outline", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(10.0).alias("shared"))
    got = C.nested_outlines(cells, borders.union(borders.select("outline", F.col("b").alias("a"), F.col("a").alias("b"), "shared")), 3, 1.0, 1.0)
    return got.select("outline", "level", F.when(F.col("ring").isNotNull(), G.js_round(G.area("ring"))).alias("area"))


@query(_with(D.PIECES_SQL, tail=f"""
SELECT piece_id, {R6.format('0.1e0')} AS x, {R6.format('0')} AS low, {R6.format('h')} AS high FROM d_piece"""))
def snapped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snap_fold and snap_fold_at: an edge drawn beside the left side of each piece lands on it; trapezoids, which have no upright side, stand as rectangles."""
    upright = F.when(F.col("shape") == 1, D.rectangle(F.col("w"), F.col("h"))).otherwise(F.col("outline"))
    rows = D.pieces(spark, sf_dir).withColumn("ring", G.translate(upright, 0.1, 0.0))
    edge = F.struct(F.array(F.lit(0.0), F.lit(0.0)).alias("a"), F.array(F.lit(0.0), F.col("h")).alias("b"))
    got = B.with_snapped_fold(rows.select("piece_id", F.col("ring").alias("outline"), edge.alias("edge")), 1.0)
    return got.select("piece_id", r6(F.col("fold")[0][0]).alias("x"), r6(F.col("fold")[0][1]).alias("low"), r6(F.col("fold")[1][1]).alias("high"))


@query(_with(D.PIECES_SQL, tail="""
SELECT piece_id, CASE WHEN piece_id % 5 = 0 THEN 'rect.name' WHEN piece_id % 5 = 1 THEN 'rect.material' WHEN piece_id % 5 = 2 THEN 'rect.count,rect.size' ELSE '' END AS problems, floor(w * h * 10 + 0.5) / 10 AS area FROM d_piece"""))
def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rectangle_shape and rectangle_problems."""
    m = F.col("piece_id") % 5
    cut = F.when(m == 1, F.expr("CAST(array() AS array<struct<material:string,count:int>>)")).otherwise(F.array(F.struct(F.lit("main").alias("material"), F.when(m == 2, 0).otherwise(1).alias("count"))))
    sizes = F.create_map(F.lit("uni"), F.struct(F.when(m == 2, -1.0).otherwise(F.col("w")).alias("width"), F.col("h").alias("height")))
    return D.pieces(spark, sf_dir).select("piece_id", F.array_join(B.rectangle_problems(F.when(m == 0, " ").otherwise("Band"), cut, sizes), ",").alias("problems"), B.rectangle_shape(F.col("w"), F.col("h"))["area"].alias("area"))


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS pattern_id, CAST(count(*) AS BIGINT) AS n, max(CAST(1 + o_orderkey % 120 AS INTEGER)) FILTER (WHERE 1 + o_orderkey % 120 <= 100) AS most
FROM orders WHERE 1 + o_orderkey % 120 <= 100 GROUP BY 1""")
def workspace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse_workspace: order lines written as a document per order and read back, those with a quantity out of range dropped."""
    line = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("patternId"), F.lit("uni").alias("size"), (1 + F.col("o_orderkey") % 120).cast("int").alias("quantity"))
    docs = D.table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.array(line).alias("order"))).alias("value"))
    return J.workspace_lines(docs).groupBy("pattern_id").agg(F.count("*").alias("n"), F.max("quantity").alias("most"))


@query(_with(D.PIECES_SQL, tail=f"""
, two AS (SELECT piece_id, shape, w, h, size, k, CASE shape WHEN 0 THEN 0.64e0 ELSE 1e0 END AS part FROM d_piece, (VALUES ('S', 1e0), ('M', 2e0)) t(size, k)), made AS (
    SELECT piece_id, 'front' AS id, size, 'Front' AS name, w * k AS width, h * k AS height, part * w * h * k * k AS area FROM two
    UNION ALL SELECT piece_id, 'front-2', unnest(['S', 'M', 'L']), 'Front', w, h, part * w * h FROM two WHERE size = 'S'
    UNION ALL SELECT piece_id, 'back-short', 'S', 'Back – Short', w + 0.12e0, h + 0.12e0, (w + 0.12e0) * (h + 0.12e0) FROM two WHERE shape <> 0 AND size = 'S'
    UNION ALL SELECT piece_id, 'back-long', 'S', 'Back – Long', 2 * w + 0.12e0, h + 0.12e0, (2 * w + 0.12e0) * (h + 0.12e0) FROM two WHERE shape <> 0 AND size = 'S'
    UNION ALL SELECT piece_id, 'front-3', 'M', 'Front', w, 3, w * 3 FROM two WHERE size = 'M')
SELECT piece_id, id, size, name, floor(width * 10 + 0.5) / 10 AS width, floor(height * 10 + 0.5) / 10 AS height, floor(area * 10 + 0.5) / 10 AS area FROM made WHERE piece_id % 7 <> 0"""))
def built_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """build_pattern: a piece with its own sizes, one with the reference in all sizes, variants of cells, a rectangle; every seventh document names an outline that is gone."""
    upright = F.when(F.col("shape") == 1, D.rectangle(F.col("w"), F.col("h"))).otherwise(F.col("outline"))
    rows = D.pieces(spark, sf_dir).withColumn("outline", upright).withColumn("doc", F.col("piece_id").cast("string"))
    double = F.transform("outline", lambda p: F.array(p[0] * 2, p[1] * 2))
    sizes = F.array(F.struct(F.lit("S").alias("size"), F.col("outline").alias("ring"), F.lit(True).alias("reference")), F.struct(F.lit("M").alias("size"), double.alias("ring"), F.lit(False).alias("reference")))
    outlines = rows.select("doc", F.lit("c").alias("candidate"), F.explode(sizes).alias("s")).select("doc", "candidate", "s.*")
    two = F.array(F.struct(F.lit(1).cast("long").alias("id"), F.col("outline").alias("ring")), F.struct(F.lit(2).cast("long").alias("id"), G.translate("outline", F.col("w"), 0.0).alias("ring")))
    cells = rows.select("doc", F.lit("c").alias("candidate"), F.lit("S").alias("size"), F.explode(two).alias("c")).select("doc", "candidate", "size", "c.*")
    fixed = spark.createDataFrame([
        (0, "c", " Front ", False, True, None), (1, "c", "Front", True, True, None), (2, "c", "Unused", False, False, None),
        (3, "c", "Back", False, True, [("Short", {"S": [1]}), ("Long", {"S": [1, 2]})]), (4, "lost", "Lost", False, True, None)],
        "pos int, candidate string, name string, all_sizes boolean, include boolean, variants array<struct<label:string,cells:map<string,array<bigint>>>>")
    own = F.broadcast(fixed)  # five rows
    cut = F.array(F.struct(F.lit(" main ").alias("material"), F.lit(2).alias("count"))).alias("cut")
    drafts = rows.select("doc", "piece_id", "shape").join(own, ((F.col("pos") != 3) | (F.col("shape") != 0)) & ((F.col("pos") != 4) | (F.col("piece_id") % 7 == 0)))
    drafts = drafts.select("doc", "pos", "candidate", "name", cut, F.lit(90.0).alias("grain"), F.lit(None).cast("int").alias("fold_edge"), "all_sizes", "include", F.lit(False).alias("optional"), F.lit("").alias("variant"), F.lit("").alias("variant_group"), "variants")
    meta = rows.select("doc", "doc", F.lit("Pattern"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("none"), F.array(F.lit("S"), F.lit("M"), F.lit("L"))).toDF("doc", "id", "name", "author", "source", "seam_allowance", "sizes")
    band = F.create_map(F.lit("M"), F.struct(F.col("w").alias("width"), F.lit(3.0).alias("height")))
    rectangles = rows.select("doc", F.lit(0).alias("pos"), F.lit("Front").alias("name"), cut, F.lit(False).alias("optional"), F.lit("").alias("variant"), F.lit("").alias("variant_group"), band.alias("sizes"))
    good, _ = N.build_pattern(outlines, drafts, meta, cells, rectangles, cm_per_pt=1.0, pixel_mm=1.0)
    piece = good.select("doc", F.explode("pieces").alias("p")).select("doc", "p.id", "p.name", F.explode("p.sizes").alias("size", "s"))
    return piece.select(F.col("doc").cast("long").alias("piece_id"), "id", "size", "name", F.col("s.bbox")[0].alias("width"), F.col("s.bbox")[1].alias("height"), F.col("s.area").alias("area"))
