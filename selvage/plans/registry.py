"""Registered queries of the marker-planning operators, and SQL for those that SQL can express.

They run over the derived fixtures (:mod:`selvage.plans.derived`), whole tables.
Numbers are rounded half up on both sides, so that the last bits don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.functions import labels as L
from selvage.functions import text as X
from selvage.operators import building as B
from selvage.operators import cells as C
from selvage.operators import layout as Y
from selvage.operators import nesting as N
from selvage.operators import prepare as P
from selvage.operators import sheet as S
from selvage.operators import summary as M
from selvage.operators import tracing as V
from selvage.operators.groups import dealt
from selvage.plans import derived as D
from selvage.sources import documents as J
from selvage.streaming import progress as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(x: Column | str) -> Column:
    return G.js_round(F.col(x) if isinstance(x, str) else x, 6)


def _with(*parts: str, tail: str) -> str:
    return "WITH " + ", ".join(parts) + tail


_EDGES = """
, d_edge AS (
    SELECT piece_id, i, outline[i] AS a, outline[i % len(outline) + 1] AS b FROM (SELECT piece_id, outline, unnest(range(1, len(outline) + 1)) AS i FROM d_ring)
)"""
R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


@query(_with(D.PIECES_SQL, tail=_EDGES + f" SELECT piece_id, {R6.format('sum(a[1] * b[2] - b[1] * a[2]) / 2')} AS signed_area FROM d_edge GROUP BY piece_id"))
def signed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pieces(spark, sf_dir).select("piece_id", r6(G.signed_area("outline")).alias("signed_area"))


@query(_with(D.PIECES_SQL, tail=_EDGES + f"""
SELECT piece_id, {R6.format('min(a[1])')} AS min_x, {R6.format('min(a[2])')} AS min_y, {R6.format('max(a[1]) - min(a[1])')} AS width, {R6.format('max(a[2]) - min(a[2])')} AS height FROM d_edge GROUP BY piece_id"""))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = G.bbox("outline")
    return D.pieces(spark, sf_dir).select("piece_id", *(r6(b[c]).alias(c) for c in ("min_x", "min_y", "width", "height")))


_CENTROID = _EDGES + """
, d_centre AS (
    SELECT piece_id, sum((a[1] + b[1]) * (a[1] * b[2] - b[1] * a[2])) / (3 * sum(a[1] * b[2] - b[1] * a[2])) AS x,
        sum((a[2] + b[2]) * (a[1] * b[2] - b[1] * a[2])) / (3 * sum(a[1] * b[2] - b[1] * a[2])) AS y
    FROM d_edge GROUP BY piece_id
)"""


@query(_with(D.PIECES_SQL, tail=_CENTROID + f" SELECT piece_id, {R6.format('x')} AS x, {R6.format('y')} AS y FROM d_centre"))
def centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = G.centroid("outline")
    return D.pieces(spark, sf_dir).select("piece_id", r6(c[0]).alias("x"), r6(c[1]).alias("y"))


@query(_with(D.PIECES_SQL, tail=_EDGES + f"""
, d_turn AS (SELECT piece_id, a[1] * cos(radians(30e0)) - a[2] * sin(radians(30e0)) AS x, a[1] * sin(radians(30e0)) + a[2] * cos(radians(30e0)) AS y FROM d_edge)
SELECT piece_id, {R6.format('max(x) - min(x)')} AS width, {R6.format('max(y) - min(y)')} AS height FROM d_turn GROUP BY piece_id"""))
def rotated_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = D.pieces(spark, sf_dir).withColumn("turned", G.normalize(G.rotate("outline", 30)))
    return turned.select("piece_id", r6(F.array_max(G.xs("turned"))).alias("width"), r6(F.array_max(G.ys("turned"))).alias("height"))


@query(_with(D.PIECES_SQL, tail=_EDGES + f" SELECT piece_id, {R6.format('-sum(a[1] * b[2] - b[1] * a[2]) / 2')} AS mirrored_area, {R6.format('sum(max_x - a[1])')} AS sum_x FROM d_edge JOIN (SELECT piece_id AS p, max(a[1]) AS max_x FROM d_edge GROUP BY piece_id) ON p = piece_id GROUP BY piece_id"))
def mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = D.pieces(spark, sf_dir).withColumn("m", G.mirror_x("outline"))
    return m.select("piece_id", r6(G.signed_area("m")).alias("mirrored_area"), r6(F.aggregate(G.xs("m"), F.lit(0.0), lambda s, v: s + v)).alias("sum_x"))


@query(_with(D.PIECES_SQL, tail=_CENTROID + """
SELECT d_centre.piece_id, count(*) FILTER (WHERE (a[2] > y) <> (b[2] > y) AND x < (b[1] - a[1]) * (y - a[2]) / (b[2] - a[2]) + a[1]) % 2 = 1 AS inside
FROM d_centre JOIN d_edge ON d_edge.piece_id = d_centre.piece_id GROUP BY d_centre.piece_id"""))
def centroid_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = D.pieces(spark, sf_dir).withColumn("c", G.centroid("outline"))
    return c.select("piece_id", G.contains_point("outline", F.col("c")[0], F.col("c")[1]).alias("inside"))


@query(_with(D.PIECES_SQL, tail=_EDGES + f"""
, d_near AS (
    SELECT piece_id, a, b, greatest(0e0, least(1e0, ((30 - a[1]) * (b[1] - a[1]) + (20 - a[2]) * (b[2] - a[2])) / ((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2))) AS t FROM d_edge
)
SELECT piece_id, {R6.format('min(sqrt((30 - a[1] - (b[1] - a[1]) * t) ** 2 + (20 - a[2] - (b[2] - a[2]) * t) ** 2))')} AS distance FROM d_near GROUP BY piece_id"""))
def ring_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.array(F.lit(30.0), F.lit(20.0))
    return D.pieces(spark, sf_dir).select("piece_id", r6(G.ring_distance(p, "outline")).alias("distance"))


_SPANS = "SELECT l_suppkey AS k, CAST(l_partkey AS BIGINT) * 10 AS a, CAST(l_partkey AS BIGINT) * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem"


@query(f"""
WITH s AS ({_SPANS}), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, island""")
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"), (F.col("l_partkey").cast("long") * 10).alias("a"), (F.col("l_partkey").cast("long") * 10 + F.col("l_quantity").cast("long")).alias("b"))
    return S.merge_spans(rows, ["k"])


@query("""
WITH v AS (SELECT l_suppkey AS k, l_extendedprice AS x, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
SELECT k, max(x) FILTER (WHERE r = n // 2 + 1) AS median FROM v GROUP BY k""")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(S.upper_median("l_extendedprice").alias("median"))


_JOB = f"""{D.PIECES_SQL}, {D.LINES_SQL}, {D.FABRICS_SQL}
, d_job AS (
    SELECT run_id, d_line.material, copies, d_line.piece_id, h, coalesce(width, 140e0) AS width, coalesce(folded, false) AS folded
    FROM d_line JOIN d_piece ON d_piece.piece_id = d_line.piece_id LEFT JOIN d_fabric ON d_fabric.material = d_line.material
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their piece and fabric, a default where the material has none."""
    lines, pieces = D.order_lines(spark, sf_dir), D.pieces(spark, sf_dir)
    rows = lines.join(dealt(pieces), "piece_id").join(F.broadcast(D.fabrics(spark)), "material", "left")  # two rows
    return rows.select("run_id", "line_id", "material", "copies", "piece_id", "h", "outline", "rotation", F.coalesce("width", F.lit(140.0)).alias("width"), "length", F.coalesce("folded", F.lit(False)).alias("folded"))


@query(f"WITH {_JOB} SELECT run_id, material, CAST(sum(copies) AS BIGINT) AS copies, count(DISTINCT piece_id) AS shapes, max(width) AS width, bool_or(folded) AS folded FROM d_job GROUP BY run_id, material")
def order_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("run_id", "material").agg(
        F.sum("copies").alias("copies"), F.count_distinct("piece_id").alias("shapes"), F.max("width").alias("width"), F.bool_or("folded").alias("folded"))


@query(f"""
WITH {_JOB}
, m AS (SELECT run_id, material, sum(h * copies) AS used, max(width) AS width, bool_or(folded) AS folded FROM d_job GROUP BY run_id, material)
SELECT run_id, material, CASE WHEN folded THEN 'summary.buyFolded' ELSE 'summary.buy' END AS code,
    floor(greatest(0, ceil(used / 5 - 1e-9)) * 5 + 0.5) / 100 AS metres, floor(used * 10 + 0.5) / 10 AS exact
FROM m""")
def fabric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length to buy if all copies of a run lay one below the other."""
    used = jobs(spark, sf_dir).groupBy("run_id", "material").agg(
        F.sum(F.col("h") * F.col("copies")).alias("used_length"), F.max("width").alias("width"), F.bool_or("folded").alias("folded"), F.sum("copies").alias("copies"))
    rows = used.withColumn("key", F.struct("run_id", "material")).select(F.col("key").alias("material"), "width", F.lit(None).cast("double").alias("length"), "folded", "copies", F.col("copies").alias("placed"), F.lit(0).alias("unplaced"), "used_length")
    return M.fabric_summary(rows).select("material.run_id", "material.material", "code", "metres", "exact")


@query(f"""
WITH l AS (SELECT sum(l_quantity) AS used, l_orderkey AS run_id FROM lineitem GROUP BY l_orderkey)
SELECT run_id, CAST(greatest(0, ceil(used / 5 - 1e-9)) * 5 AS BIGINT) AS to_buy, CAST(floor(used / 10) + 1 AS BIGINT) AS marks FROM l""")
def length_to_buy(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = D.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.sum("l_quantity").alias("used"))
    return used.select("run_id", M.length_to_buy("used").cast("long").alias("to_buy"), F.size(M.ticks("used")).cast("long").alias("marks"))


@query("SELECT * FROM (VALUES ('lining', CAST(3 AS BIGINT), CAST(0 AS BIGINT)), ('outer', 12, 3)) t(material, copies, mirrored)")
def sample_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample pattern, three times: copies per material."""
    cuts = P.cuts(D.demo_lines(spark, 3), D.demo_pattern(spark), D.fabrics(spark))
    return P.copies(cuts).groupBy("material").agg(F.count("*").alias("copies"), F.count_if("mirrored").alias("mirrored"))


@query("SELECT '1' AS line_id, CAST(3 AS BIGINT) AS selected, CAST(4 AS BIGINT) AS total")
def sample_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.piece_counts(D.demo_lines(spark, 1), D.demo_pattern(spark)).select("line_id", F.col("selected").cast("long").alias("selected"), F.col("total").cast("long").alias("total"))


@query("SELECT 'prepare.surplus' AS code, 'Sample bag' AS pattern, 'Small pocket' AS piece, 'outer' AS material, CAST(3 AS BIGINT) AS n")
def sample_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = spark.createDataFrame([("outer", 140.0, None, True, False)], "material string, width double, length double, folded boolean, directional boolean")
    lines, patterns = D.demo_lines(spark, 3), D.demo_pattern(spark)
    return P.notes(lines, patterns, P.cuts(lines, patterns, folded))


def single_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line once: many small markers."""
    return jobs(spark, sf_dir).select(
        F.col("run_id").cast("string").alias("run_id"), "material", F.col("line_id").alias("seq"), F.concat_ws(":", "line_id", "piece_id").alias("key"), F.col("outline").alias("polygon"),
        "rotation", F.lit(False).alias("fold_edge"), F.lit(0.0).alias("tilt"), "width", "length", "folded")


OPTIONS = N.Options(gap=0.0, resolution=1.0, seed=42, passes=1)


@query()
def nest_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One greedy pass for the marker of each order and material."""
    return N.nest_markers(single_copies(spark, sf_dir), OPTIONS)


@query(f"WITH {_JOB} SELECT CAST(run_id AS VARCHAR) AS run_id, material, count(*) AS placed FROM d_job GROUP BY run_id, material")
def nest_all_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a roll that is wide enough every piece finds its place."""
    return nest_markers(spark, sf_dir).where("unplaced = 0").select("run_id", "material", "placed")


@query()
def nest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(R.nest_events(single_copies(spark, sf_dir), N.Options(gap=0.0, resolution=1.0, seed=42, passes=3)))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS material, arg_max(value, event_id) AS used_length FROM events GROUP BY user_id, event_type")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest state of each producer: events stand in for progress messages."""
    rows = D.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("material"), F.col("event_id").alias("seq"), F.lit("progress").alias("kind"),
        F.col("value").alias("used_length"), F.lit(0).alias("unplaced"), F.lit(1).alias("iterations"))
    return R.latest(rows).select("run_id", "material", "used_length")


_SUBPATH = """
d_line4 AS (
    SELECT p_partkey % 25 AS doc, CAST(p_partkey // 25 % 4 + 1 AS INTEGER) AS page, p_partkey AS path, 5 + p_partkey * 37 % 400 AS x, 7 + p_partkey * 53 % 500 AS y,
        20 + p_partkey * 17 % 90 AS w, 10 + p_partkey * 29 % 70 AS h, p_partkey % 2 = 0 AS closed, CASE p_partkey % 3 WHEN 0 THEN 'fill:0' WHEN 1 THEN 'stroke:1' ELSE 'stroke:2' END AS style
    FROM part
)"""


def subpaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corner of three points for each part, on one of four pages of 25 documents, and the same frame on every page."""
    i = F.col("p_partkey").cast("long")
    rows = D.table(spark, sf_dir, "part").select(
        (i % 25).alias("doc"), (F.floor(i / 25) % 4 + 1).cast("int").alias("page"), i.alias("path"), F.lit(0).alias("sub"),
        *((a + i * m % n).cast("double").alias(c) for c, a, m, n in (("x", 5, 37, 400), ("y", 7, 53, 500), ("w", 20, 17, 90), ("h", 10, 29, 70))),
        (i % 2 == 0).alias("closed"), F.when(i % 3 == 0, "fill:0").when(i % 3 == 1, "stroke:1").otherwise("stroke:2").alias("style"))
    x, y, w, h = (F.col(c) for c in "xywh")
    points = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h))
    return rows.select("doc", "page", "path", "sub", points.alias("points"), "closed", "style")


def framed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = subpaths(spark, sf_dir)
    pages = own.select("doc", "page").distinct().withColumn("width", F.lit(500.0)).withColumn("height", F.lit(700.0))
    frame = F.expr("array(array(1D, 1D), array(499D, 1D), array(499D, 699D), array(1D, 699D))")
    frames = pages.select("doc", "page", F.lit(0).cast("long").alias("path"), F.lit(0).alias("sub"), frame.alias("points"), F.lit(True).alias("closed"), F.lit("stroke:1").alias("style"))
    return own.unionByName(frames), pages


@query(f"""
WITH {_SUBPATH}, l AS (
    SELECT doc, style, path, closed, (w + h + CASE WHEN closed THEN sqrt(w * w + h * h) ELSE 0 END) / CASE WHEN style = 'fill:0' THEN 2 ELSE 1 END AS len FROM d_line4
)
SELECT doc, style, count(*) AS paths, {R6.format('sum(len)')} AS length_pt, {R6.format('sum(CASE WHEN closed THEN len ELSE 0 END)')} AS closed_length_pt FROM l GROUP BY doc, style""")
def style_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.style_legend(subpaths(spark, sf_dir)).select("doc", "style", "paths", r6("length_pt").alias("length_pt"), r6("closed_length_pt").alias("closed_length_pt"))


@query(f"""
WITH {_SUBPATH}, s AS (
    SELECT a.doc, a.path, count(DISTINCT b.page) AS pages_on FROM d_line4 a JOIN d_line4 b ON a.doc = b.doc AND a.x = b.x AND a.y = b.y AND a.w = b.w AND a.h = b.h GROUP BY a.doc, a.path
), n AS (SELECT doc, greatest(2, ceil(count(DISTINCT page) / 2.0)) AS need FROM d_line4 GROUP BY doc)
SELECT s.doc, count(*) AS kept FROM s JOIN n ON s.doc = n.doc WHERE pages_on < need GROUP BY s.doc""")
def content_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subpaths left of each document without the page frames."""
    rows, pages = framed(spark, sf_dir)
    return S.content(rows, pages).groupBy("doc").agg(F.count("*").alias("kept"))


@query(f"""
WITH {_SUBPATH}, c AS (SELECT doc, page, 'P' || CAST(path % 7 AS VARCHAR) AS str, CAST(x % 40 AS DOUBLE) + CASE WHEN page % 2 = 0 THEN 480 ELSE 0 END AS x, CAST(y % 40 AS DOUBLE) + CASE WHEN page > 2 THEN 680 ELSE 0 END AS y FROM d_line4)
SELECT DISTINCT doc, str, x, y FROM c""")
def assemble_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all four pages on one sheet, each once."""
    first = F.col("points")[0]
    texts = subpaths(spark, sf_dir).select("doc", "page", F.concat(F.lit("P"), (F.col("path") % 7).cast("string")).alias("str"), (first[0] % 40).alias("x"), (first[1] % 40).alias("y"), F.lit(8.0).alias("height"))
    return S.assemble_texts(texts, place_pages(spark, sf_dir)).select("doc", "str", "x", "y")


@query(f"""
WITH {_SUBPATH}, p AS (SELECT DISTINCT doc, style, closed, x + CASE WHEN page % 2 = 0 THEN 480 ELSE 0 END AS x, y + CASE WHEN page > 2 THEN 680 ELSE 0 END AS y, w, h FROM d_line4),
f AS (SELECT DISTINCT doc, page FROM d_line4), a AS (SELECT doc, style FROM p UNION ALL SELECT doc, 'stroke:1' FROM f)
SELECT doc, style, count(*) AS n FROM a GROUP BY doc, style""")
def assemble_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and frames of four pages on one sheet, near-identical ones of a style once."""
    rows, pages = framed(spark, sf_dir)
    blocks = pages.select("doc").distinct().select("doc", F.lit(0).alias("block"), F.lit(1).alias("first"), F.expr("array(2, 2)").alias("rows"), F.lit(480.0).alias("step_x"), F.lit(680.0).alias("step_y"))
    return S.assemble_paths(rows, S.place_pages(blocks, pages)).groupBy("doc", "style").agg(F.count("*").alias("n"))


@query("""
WITH d AS (SELECT p_partkey % 25 AS doc, p_partkey // 25 % 4 + 1 AS page FROM part GROUP BY 1, 2)
SELECT doc, CAST(page AS INTEGER) AS page, CASE WHEN page % 2 = 0 THEN 480e0 ELSE 0e0 END AS x, CASE WHEN page > 2 THEN 680e0 ELSE 0e0 END AS y FROM d""")
def place_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, pages = framed(spark, sf_dir)
    blocks = pages.select("doc").distinct().select("doc", F.lit(0).alias("block"), F.lit(1).alias("first"), F.expr("array(2, 2)").alias("rows"), F.lit(480.0).alias("step_x"), F.lit(680.0).alias("step_y"))
    return S.place_pages(blocks, pages).select("doc", "page", "x", "y")


_REPEATED = """
d_shape AS (
    SELECT p_partkey // 400 AS doc, CAST(p_partkey % 4 + 1 AS INTEGER) AS page, p_partkey AS path, 5 + p_partkey * 37 % 400 AS x, 7 + p_partkey * 53 % 500 AS y, 20 + p_partkey * 17 % 9 * 10 AS w, 10 + p_partkey * 29 % 7 * 10 AS h FROM part
)"""


@query(f"""
WITH {_REPEATED}, o AS (SELECT *, count(*) OVER (PARTITION BY doc, page, w, h) AS c FROM d_shape), k AS (SELECT * FROM o WHERE c <= 4),
v AS (
    SELECT a.doc, a.page AS a, b.page AS b, a.x - b.x AS dx, a.y - b.y AS dy, count(*) AS votes FROM k a JOIN k b ON a.doc = b.doc AND a.w = b.w AND a.h = b.h AND a.page < b.page
    WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) >= 5 GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, a, b ORDER BY votes DESC, dx, dy) AS n FROM v)
SELECT doc, a, b, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, votes FROM r WHERE n <= 4""")
def page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape_key and matches: 400 parts a document as corners of 63 shapes, on four pages."""
    i = F.col("p_partkey").cast("long")
    rows = D.table(spark, sf_dir, "part").select(
        F.floor(i / 400).alias("doc"), (i % 4 + 1).cast("int").alias("page"), i.alias("path"), F.lit(0).alias("sub"),
        *(v.cast("double").alias(c) for c, v in (("x", 5 + i * 37 % 400), ("y", 7 + i * 53 % 500), ("w", 20 + i * 17 % 9 * 10), ("h", 10 + i * 29 % 7 * 10))))
    points = F.expr("array(array(x, y), array(x + w, y), array(x + w, y + h))")
    return S.page_matches(rows.select("doc", "page", "path", "sub", points.alias("points"), F.lit(False).alias("closed"), F.lit("stroke:1").alias("style")))


@query(f"""
WITH {_SUBPATH}, s AS (
    SELECT doc, x AS px, y AS py, x + w AS qx, y AS qy FROM d_line4 UNION ALL SELECT doc, x + w, y, x + w, y + h FROM d_line4 UNION ALL SELECT doc, x + w, y + h, x, y FROM d_line4 WHERE closed),
t AS (SELECT p_partkey AS tap, p_partkey % 25 AS doc, p_partkey * 31 % 500 AS x, p_partkey * 67 % 600 AS y FROM part),
n AS (SELECT tap, x, y, px, py, qx - px AS dx, qy - py AS dy, greatest(0e0, least(1e0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / ((qx - px) ** 2 + (qy - py) ** 2))) AS q FROM t JOIN s ON s.doc = t.doc),
d AS (SELECT tap, min(sqrt((x - px - q * dx) ** 2 + (y - py - q * dy) ** 2)) AS distance FROM n GROUP BY tap)
SELECT tap, {R6.format('distance')} AS distance FROM d WHERE distance <= 6""")
def nearest_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tap for each part, against the lines of its sheet."""
    i = F.col("p_partkey").cast("long")
    taps = D.table(spark, sf_dir, "part").select(i.alias("tap"), (i % 25).alias("doc"), (i * 31 % 500).cast("double").alias("x"), (i * 67 % 600).cast("double").alias("y"), F.lit(6.0).alias("tolerance"))
    return S.nearest_segment(taps, S.segments(subpaths(spark, sf_dir))).select("tap", r6("distance").alias("distance"))


@query()
def overlap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's rectangle joins the supplier rectangle that it shares the largest area with."""
    def rectangles(name: str, key: str) -> DataFrame:
        k = F.col(key)
        x, y, w, h = (k * 71 % 900).cast("double"), (k * 113 % 900).cast("double"), (30 + k * 17 % 50).cast("double"), (30 + k * 23 % 50).cast("double")
        return D.table(spark, sf_dir, name).select(k.alias("id"), F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h)).alias("outline"))

    got = S.group_by_overlap(rectangles("customer", "c_custkey"), rectangles("supplier", "s_suppkey"), M.intersection_area)
    return got.select("ring", "ref", r6("shared").alias("shared"))


ORACLE_SQL["overlap_groups"] = """
WITH r AS (SELECT c_custkey AS ring, CAST(c_custkey * 71 % 900 AS DOUBLE) AS x, CAST(c_custkey * 113 % 900 AS DOUBLE) AS y, CAST(30 + c_custkey * 17 % 50 AS DOUBLE) AS w, CAST(30 + c_custkey * 23 % 50 AS DOUBLE) AS h FROM customer),
s AS (SELECT s_suppkey AS ref, CAST(s_suppkey * 71 % 900 AS DOUBLE) AS x2, CAST(s_suppkey * 113 % 900 AS DOUBLE) AS y2, CAST(30 + s_suppkey * 17 % 50 AS DOUBLE) AS w2, CAST(30 + s_suppkey * 23 % 50 AS DOUBLE) AS h2 FROM supplier),
o AS (SELECT ring, ref, (least(x + w, x2 + w2) - greatest(x, x2)) * (least(y + h, y2 + h2) - greatest(y, y2)) AS shared, least(w * h, w2 * h2) AS smaller
    FROM r JOIN s ON x < x2 + w2 AND x2 < x + w AND y < y2 + h2 AND y2 < y + h),
b AS (SELECT *, row_number() OVER (PARTITION BY ring ORDER BY shared DESC, ref) AS n FROM o WHERE shared / smaller >= 0.5)
SELECT ring, ref, shared FROM b WHERE n = 1"""


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS value, l_extendedprice * 2.54 AS cm FROM lineitem")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with a comma, read back as numbers and as inches."""
    text = F.regexp_replace(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), r"\.", ",")
    rows = D.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.alias("t"))
    return rows.select("k", "n", X.parse_decimal("t").alias("value"), X.parse_length("t", "in").alias("cm"))


@query("""
SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN 'shared' WHEN p_size % 7 = 0 THEN 'none' ELSE 'named' END AS role,
    CASE WHEN p_size % 5 = 0 THEN '34,36' WHEN p_size % 7 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || ',34,36' END AS sizes
FROM part WHERE p_size NOT IN (34, 36)
UNION ALL SELECT p_partkey, 'named', CAST(p_size AS VARCHAR) || ',' || CASE WHEN p_size = 34 THEN '36' ELSE '34' END FROM part WHERE p_size IN (34, 36)""")
def assigned_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one assignment stands for: a size and all named ones, only these, or nothing."""
    size = F.col("p_size").cast("string")
    value = F.when(F.col("p_size") % 5 == 0, "vše").when(F.col("p_size") % 7 == 0, " ;").otherwise(F.concat(size, F.lit(" , uni")))
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), value.alias("v"))
    return rows.select("k", X.size_role("v").alias("role"), F.array_join(X.assigned_sizes("v", F.array(F.lit("34"), F.lit("36"))), ",").alias("sizes"))


@query("SELECT o_custkey AS id, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("latest"))
    new = D.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderkey").alias("latest"))
    return J.upsert(old, new)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without those of which something came back."""
    rows = D.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return J.delete(rows, D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")).distinct())


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(6 AS BIGINT) ELSE 4 END AS points FROM part")
def pattern_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces written as JSON patterns and parsed back, all of them valid."""
    rows = D.pieces(spark, sf_dir)
    shape = F.struct("outline", F.array("w", "h").alias("bbox"), G.area("outline").alias("area"))
    piece = F.struct(F.lit("p").alias("id"), F.lit("Piece").alias("name"), F.array(F.struct(F.lit("main").alias("material"), F.lit(1).alias("count"))).alias("cut"), F.create_map(F.lit("uni"), shape).alias("sizes"))
    text = F.to_json(F.struct(F.lit(J.FORMAT).alias("format"), F.col("piece_id").cast("string").alias("id"), F.lit("P").alias("name"), F.lit("none").alias("seamAllowance"), F.array(F.lit("uni")).alias("sizes"), F.array(piece).alias("pieces")))
    good, _ = J.parse_patterns(rows.select(text.alias("value")))
    return good.select("id", F.size(F.element_at(F.col("pieces")[0]["sizes"], "uni")["outline"]).cast("long").alias("points"))


def cell_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A chain of cells for each supplier: its line items in order."""
    n = D.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    each = n.select(F.col("l_suppkey").cast("string").alias("outline"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("id"), "n")
    cells = each.select("outline", "id", (F.lit(100.0) + F.when(F.col("id") == 1, 50.0).otherwise(0.0)).alias("area"))
    steps = each.where("id < n")
    borders = steps.select("outline", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(10.0).alias("shared"))
    return cells, borders.union(borders.select("outline", F.col("b").alias("a"), F.col("a").alias("b"), "shared"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS outline, CAST(count(*) - 1 AS INTEGER) AS last_step FROM lineitem GROUP BY l_suppkey HAVING count(*) > 1")
def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chain_order(*cell_graph(spark, sf_dir), cm_per_pt=1.0).groupBy("outline").agg(F.max("step").alias("last_step"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS outline, CAST(count(*) AS BIGINT) AS levels FROM lineitem GROUP BY l_suppkey")
def onion_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.onion_levels(*cell_graph(spark, sf_dir), cm_per_pt=1.0).groupBy("outline").agg(F.count_distinct("level").alias("levels"))


@query("""
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'lining' WHEN 1 THEN 'main' WHEN 2 THEN 'podšívka' ELSE 'main' END AS material,
    CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 2 WHEN 3 THEN 1 ELSE p_size END AS INTEGER) AS count, 'Part ' || chr(CAST(65 + p_partkey % 26 AS INTEGER)) || 'x' AS name
FROM part""")
def cut_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut instructions in several wordings read from the labels of a piece."""
    i = F.col("p_partkey")
    n = F.col("p_size").cast("string")
    name = F.concat(F.lit("Part "), F.char((65 + i % 26).cast("long")), F.lit("x"))
    label = F.when(i % 4 == 0, F.concat(F.lit("cut "), n, F.lit(" pairs lining"))).when(i % 4 == 1, F.concat(n, F.lit("x"))).when(i % 4 == 2, F.concat(F.lit("Podšívku "), n, F.lit("×"))).otherwise(F.lit("scale 10 cm"))
    rows = D.table(spark, sf_dir, "part").select(i.alias("doc"), i.alias("id"), F.array(name, label).alias("labels"))
    parsed = L.cut_labels(rows)
    return parsed.select("id", F.col("parsed.cut")[0]["material"].alias("material"), F.col("parsed.cut")[0]["count"].alias("count"), F.col("parsed.name").alias("name"))


@query("SELECT p_partkey % 100 AS doc, CASE WHEN p_partkey % 100 % 3 = 0 THEN 'included' WHEN p_partkey % 100 % 3 = 1 THEN 'none' ELSE 'unknown' END AS seam FROM part GROUP BY 1, 2")
def seam_allowance(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("p_partkey") % 100
    says = F.when(doc % 3 == 0, "includes 1 cm seam allowance").when(doc % 3 == 1, "Ohne  Nahtzugabe").otherwise(F.col("p_name"))
    texts = D.table(spark, sf_dir, "part").select(doc.alias("doc"), F.lit(1).alias("page"), F.col("p_partkey").cast("double").alias("x"), F.lit(0.0).alias("y"), says.alias("str"))
    return L.seam_allowance(texts)


@query("""
WITH p AS (SELECT s_suppkey AS doc, CAST(unnest(range(1, 7)) AS INTEGER) AS page FROM supplier)
SELECT doc, CASE WHEN doc % 2 = 0 THEN 1 ELSE page END AS first, CASE WHEN doc % 2 = 0 THEN 6 ELSE page END AS last FROM p GROUP BY 1, 2, 3""")
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six labelled pages for each supplier: two rows of three, or labels that contradict the order of the pages."""
    doc = F.col("s_suppkey")
    each = D.table(spark, sf_dir, "supplier").select(doc.alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page"))
    k = F.when(F.col("doc") % 2 == 0, F.col("page") - 1).otherwise(F.pmod((F.col("page") - 1) * 5 + 2, F.lit(6)))
    label = F.concat(F.when(k < 3, "A").otherwise("B"), (k % 3 + 1).cast("string"))
    texts = each.select("doc", "page", label.alias("str"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(8.0).alias("height"))
    steps = each.select("doc").distinct().select(F.col("doc").cast("string"), F.lit(180.0).alias("step_x"), F.lit(280.0).alias("step_y"))
    texts = texts.withColumn("doc", F.col("doc").cast("string"))
    found = Y.blocks(texts.select("doc", "page"), Y.grid_links(Y.label_matches(texts, steps), steps))
    return found.select(F.col("doc").cast("long").alias("doc"), "first", "last")


@query("SELECT p_partkey AS piece_id, CAST(1 AS BIGINT) AS outlines, true AS near FROM part")
def trace_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece drawn as a line and traced back: one outline, its border within 3 mm on average, with pixels of 2 mm."""
    rows = D.pieces(spark, sf_dir)
    lines = rows.select(F.col("piece_id").cast("string").alias("doc"), F.lit("uni").alias("size"), F.concat("outline", F.array(F.element_at("outline", 1))).alias("points"), F.lit(0.1).alias("width"))
    traced = V.trace_sizes(lines, cm_per_pt=1.0, pixel_mm=2.0).groupBy(F.col("doc").cast("long").alias("doc")).agg(F.count("*").alias("outlines"), F.sum("area").alias("traced"))
    own = rows.select(F.col("piece_id"), G.area("outline").alias("own"), S.polyline_length("outline", True).alias("around"))
    return own.join(dealt(traced), F.col("piece_id") == F.col("doc")).select("piece_id", "outlines", (F.abs(F.col("traced") - F.col("own")) < 0.3 * F.col("around")).alias("near"))


@query(_with(D.PIECES_SQL, tail=_EDGES + """
SELECT piece_id, floor((max(a[1]) - min(a[1])) * 10 + 0.5) / 10 AS height, floor((max(a[2]) - min(a[2])) * 10 + 0.5) / 10 AS width FROM d_edge GROUP BY piece_id"""))
def build_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose grain runs along x are turned upright."""
    rows = D.pieces(spark, sf_dir).select("piece_id", "outline", F.col("outline").alias("reference"), F.lit(0.0).alias("grain"))
    return B.build_shapes(rows, 1.0).select("piece_id", F.col("shape.bbox")[0].alias("width"), F.col("shape.bbox")[1].alias("height"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to markers: copies joined to pieces and fabrics, placed marker by marker."""
    return nest_markers(spark, sf_dir)
