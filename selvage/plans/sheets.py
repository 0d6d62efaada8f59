"""Registered queries of whole sheets: lettering, marks, frames, overviews, layouts, notches, each with SQL.

A fixture is one SQL text over the retail tables that both engines run, so the
oracle starts from the same rows and computes the answer by its own joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.operators import bundles as U
from selvage.operators import grain as N
from selvage.operators import layout as Y
from selvage.operators import lettering as T
from selvage.operators import overview as O
from selvage.operators import seams as E
from selvage.operators import sheet as S
from selvage.operators import strands as X
from selvage.operators import rounds as R
from selvage.operators import tracing as V
from selvage.plans import derived as D
from selvage.plans.registry import R6, _with, query, r6
from selvage.streaming import settled as W


def rows_of(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, supplier=D.table(spark, sf_dir, "supplier"))


def oracle(sql: str) -> str:
    return sql.format(supplier="supplier")


def _numbers(n: int) -> str:
    return "(VALUES " + ", ".join(f"({k})" for k in range(n)) + ")"


#: Two lines of glyphs, some of them simple, with gaps, colours and copies by supplier; dashes, a large area, a stroke, a dot elsewhere, a glyph of two subpaths.
LETTERS = f"""
SELECT s_suppkey AS doc, CAST(100 * r + g AS BIGINT) AS path, 0 AS sub, 'fill:' || CAST((s_suppkey + CASE WHEN s_suppkey % 5 = 0 THEN r ELSE 0 END) % 3 AS STRING) || ',0,0:0:' AS style,
    CASE WHEN g % 3 = 2 THEN 4 ELSE 8 END AS n, 30e0 + g * (6 + s_suppkey % 11) AS x, 50e0 + r * 10 AS y, 6e0 AS w, 8e0 AS h
FROM {{supplier}} CROSS JOIN {_numbers(9)} AS t(g) CROSS JOIN {_numbers(2)} AS u(r) WHERE r = 0 OR s_suppkey % 4 <> 0
UNION ALL SELECT s_suppkey, CAST(900 AS BIGINT), k, 'fill:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:0:', 8, 40e0 + 10 * k, 55e0, 6e0, 1e0 FROM {{supplier}} CROSS JOIN {_numbers(3)} AS t(k)
UNION ALL SELECT s_suppkey, CAST(901 AS BIGINT), 0, 'fill:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:0:', 8, 32e0, 52e0, 25e0, 3e0 FROM {{supplier}}
UNION ALL SELECT s_suppkey, CAST(902 AS BIGINT), 0, 'stroke:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:1:', 8, 32e0, 52e0, 6e0, 8e0 FROM {{supplier}}
UNION ALL SELECT s_suppkey, CAST(903 AS BIGINT), 0, 'fill:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:0:', 4, 30e0, 300e0, 2e0, 2e0 FROM {{supplier}}
UNION ALL SELECT s_suppkey, CAST(904 AS BIGINT), 0, 'fill:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:0:', 8, 30e0, 50e0, 6e0, 8e0 FROM {{supplier}} WHERE s_suppkey % 6 = 0
UNION ALL SELECT s_suppkey, CAST(905 AS BIGINT), k, 'fill:' || CAST(s_suppkey % 3 AS STRING) || ',0,0:0:', 8 - 4 * k, 30e0 + k, 72e0 + k, 6e0 - 2 * k, 8e0 - 2 * k FROM {{supplier}} CROSS JOIN {_numbers(2)} AS t(k)"""


@query(f"""
WITH RECURSIVE f AS ({oracle(LETTERS)}),
b AS (SELECT doc, path, split_part(any_value(style), ':', 2) AS color, min(x) AS x0, min(y) AS y0, max(x + w) AS x1, max(y + h) AS y1, max(n) > 6 AS complex
    FROM f WHERE style LIKE 'fill%' GROUP BY doc, path HAVING count(*) <= 2 AND greatest(max(x + w) - min(x), max(y + h) - min(y)) < 20),
s AS (SELECT *, greatest(x1 - x0, y1 - y0) AS size FROM b),
l AS (SELECT a.doc, a.path AS p, c.path AS q FROM s a JOIN s c ON a.doc = c.doc AND a.color = c.color AND a.complex AND c.complex
    WHERE sqrt(greatest(0, a.x0 - c.x1, c.x0 - a.x1) ** 2 + greatest(0, a.y0 - c.y1, c.y0 - a.y1) ** 2) <= 0.8 * greatest(a.size, c.size)),
r AS (SELECT doc, p, q FROM l UNION SELECT r.doc, r.p, l.q FROM r JOIN l ON r.doc = l.doc AND r.q = l.p),
m AS (SELECT doc, p AS path, min(q) AS root FROM r GROUP BY doc, p),
k AS (SELECT m.doc, root, any_value(color) AS color, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM m JOIN s ON m.doc = s.doc AND m.path = s.path GROUP BY m.doc, root HAVING count(*) >= 4),
gone AS (SELECT m.doc, m.path FROM m JOIN k ON m.doc = k.doc AND m.root = k.root
    UNION SELECT s.doc, s.path FROM s JOIN k ON s.doc = k.doc AND s.color = k.color AND NOT s.complex WHERE (s.x0 + s.x1) / 2 BETWEEN k.x0 - 2 AND k.x1 + 2 AND (s.y0 + s.y1) / 2 BETWEEN k.y0 - 2 AND k.y1 + 2)
SELECT DISTINCT f.doc, f.path FROM f ANTI JOIN gone ON f.doc = gone.doc AND f.path = gone.path""")
def lettering_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """without_lettering: what is left of each sheet."""
    ring = F.expr("""slice(array(array(x, y), array(x + w / 2, y), array(x + w, y), array(x + w, y + h), array(x, y + h), array(x, y + h / 2), array(x, y + h / 4), array(x, y + h / 8)), 1, 3)""")
    corner = F.expr("array(array(x + w, y + h), array(x, y + h), array(x, y + h / 2), array(x, y + h / 4), array(x, y + h / 8))")
    rows = rows_of(spark, sf_dir, LETTERS).withColumn("points", F.concat(ring, F.slice(corner, F.lit(1), F.col("n") - 3)))
    return T.without_lettering(rows).select("doc", "path").distinct()


#: Crosses at four corners of three pages, drawn twice; every third document has one cross only, every fifth marks on one page only; dashes everywhere.
_CORNER = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(i, j)"
MARKS = f"""
WITH m AS (
    SELECT s_suppkey AS doc, page + 1 AS page, twice, 15e0 + s_suppkey % 7 + i * (250 + s_suppkey % 11) AS x, 20e0 + j * (340 + s_suppkey % 13) AS y
    FROM {{supplier}} CROSS JOIN {_numbers(3)} AS p(page) CROSS JOIN {_numbers(2)} AS t(twice) CROSS JOIN {_CORNER}
    WHERE (s_suppkey % 3 <> 0 OR i + j = 0) AND (s_suppkey % 5 <> 0 OR page = 0))
SELECT doc, page, x + 0.2e0 * twice AS x1, y - 5 AS y1, x + 0.2e0 * twice AS x2, y + 5 AS y2 FROM m
UNION ALL SELECT doc, page, x - 5, y + 0.2e0 * twice, x + 5, y + 0.2e0 * twice FROM m
UNION ALL SELECT s_suppkey, page + 1, 100e0 + 6 * k, 30e0 + s_suppkey % 3, 104e0 + 6 * k, 30e0 + s_suppkey % 3 FROM {{supplier}} CROSS JOIN {_numbers(3)} AS p(page) CROSS JOIN {_numbers(9)} AS d(k)"""
_WIDE, _HIGH = 300.0, 400.0


def _lines(rows: DataFrame) -> DataFrame:
    points = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    return rows.select("doc", "page", F.row_number().over(Y.Window.partitionBy("doc", "page").orderBy("x1", "y1", "x2", "y2")).cast("long").alias("path"), F.lit(0).alias("sub"), points.alias("points"), F.lit(False).alias("closed"), F.lit("stroke:1").alias("style"))


def _pages(rows: DataFrame, width: float = _WIDE, height: float = _HIGH) -> DataFrame:
    return rows.select("doc", "page").distinct().withColumn("width", F.lit(width)).withColumn("height", F.lit(height))


@query(f"""
WITH f AS (SELECT DISTINCT * FROM ({oracle(MARKS)})), v AS (SELECT * FROM f WHERE x1 = x2 AND (x1 < 60 OR x1 > 240)), h AS (SELECT * FROM f WHERE y1 = y2 AND (y1 < 80 OR y1 > 320)),
c AS (SELECT DISTINCT v.doc, v.page, v.x1 AS x, h.y1 AS y FROM v JOIN h ON v.doc = h.doc AND v.page = h.page AND v.x1 BETWEEN h.x1 - 0.1 AND h.x2 + 0.1 AND h.y1 BETWEEN v.y1 - 0.1 AND v.y2 + 0.1),
m AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.doc = c.doc AND d.page = c.page AND (d.x < c.x OR d.x = c.x AND d.y < c.y) AND sqrt((d.x - c.x) ** 2 + (d.y - c.y) ** 2) < 1)),
q AS (SELECT a.doc, a.page, b.x - a.x AS w, b.y - a.y AS h FROM m a JOIN m b ON a.doc = b.doc AND a.page = b.page AND b.x - a.x >= 195 AND b.y - a.y >= 260
    WHERE EXISTS (SELECT 1 FROM m p WHERE p.doc = a.doc AND p.page = a.page AND abs(p.x - a.x) < 0.5 AND abs(p.y - b.y) < 0.5) AND EXISTS (SELECT 1 FROM m p WHERE p.doc = a.doc AND p.page = a.page AND abs(p.x - b.x) < 0.5 AND abs(p.y - a.y) < 0.5))
SELECT doc, axis, {R6.format('avg(CASE axis WHEN 0 THEN w ELSE h END)')} AS step FROM q, (VALUES (0), (1)) t(axis) GROUP BY doc, axis HAVING count(*) >= 2""")
def registration_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """registration_step: four crosses at the corners of a page, twice in a document."""
    rows = rows_of(spark, sf_dir, MARKS)
    marks = Y.registration_marks(_lines(rows), _pages(rows))
    return Y.page_steps(Y.registration_candidates(marks, _pages(rows))).select("doc", "axis", r6("step").alias("step"))


#: Frames off the middle of four pages, some drawn as two edges, every fourth document on one page only; three lines that go on across each seam, every fifth document with another slope.
FRAMED = f"""
WITH d AS (SELECT s_suppkey AS doc, page + 1 AS page, 10e0 + s_suppkey % 5 AS m FROM {{supplier}} CROSS JOIN {_numbers(4)} AS p(page)),
e AS (SELECT d.*, CASE WHEN doc % 3 = 1 THEN 0.5e0 ELSE 0e0 END * s AS off FROM d CROSS JOIN (VALUES (-1), (1)) AS t(s) WHERE doc % 4 <> 0 OR page = 1)
SELECT doc, page, m + off AS x1, 10e0 AS y1, m + off AS x2, 390e0 AS y2 FROM e
UNION ALL SELECT doc, page, m + 260 + off, 10e0, m + 260 + off, 390e0 FROM e
UNION ALL SELECT doc, page, m, 12e0 + off, m + 260, 12e0 + off FROM e
UNION ALL SELECT doc, page, m, 382e0 + off, m + 260, 382e0 + off FROM e
UNION ALL SELECT doc, page, m + 200, 40e0 + 60 * k + 11 * page - 6e0 * k, m + 262, 40e0 + 60 * k + 11 * page + 0.2e0 * k FROM d CROSS JOIN {_numbers(3)} AS t(k)
UNION ALL SELECT doc, page, m - 2, 40e0 + 60 * k + 11 * (page - 1) - 0.2e0 * k, m + 50, 40e0 + 60 * k + 11 * (page - 1) + 5e0 * k + CASE WHEN doc % 5 = 0 THEN 20 ELSE 0 END FROM d CROSS JOIN {_numbers(3)} AS t(k)"""


@query(f"""
WITH f AS (SELECT DISTINCT * FROM ({oracle(FRAMED)})), a AS (
    SELECT doc, page, 0 AS axis, x1 AS p0, x2 AS q0, y1 AS p1, y2 AS q1, 300 AS size, 400 AS across, 260 AS step FROM f UNION ALL SELECT doc, page, 1, y1, y2, x1, x2, 400, 300, 370 FROM f),
pos AS (SELECT doc, axis, step, (p0 + q0) / 2 AS v FROM a WHERE abs(p0 - q0) <= 0.3 AND abs(p1 - q1) >= 0.6 * across GROUP BY doc, axis, step, (p0 + q0) / 2 HAVING count(DISTINCT page) >= 2),
mid AS (SELECT a.doc, a.axis, a.step, avg(b.v) AS v, min(b.v) AS key FROM pos a JOIN pos b ON a.doc = b.doc AND a.axis = b.axis AND abs(a.v - b.v) < 2 GROUP BY a.doc, a.axis, a.step, a.v),
frame AS (SELECT DISTINCT l.doc, l.axis, h.v AS high, l.v AS low FROM mid l JOIN mid h ON l.doc = h.doc AND l.axis = h.axis WHERE abs(h.v - l.v - l.step) < 1),
bound AS (
    SELECT doc, axis, 'frame' || low AS kind, high, low, 1e0 AS tol FROM frame
    UNION ALL SELECT doc, axis, 'band' || part, step + (size - step) * part, (size - step) * part, 0.3 FROM (SELECT DISTINCT doc, axis, step, size FROM a), (VALUES (0.25e0), (0.5e0), (0.75e0)) t(part)),
side AS (SELECT doc, axis, kind, tol, 'end' AS side, high AS spot FROM bound UNION ALL SELECT doc, axis, kind, tol, 'start', low FROM bound),
x AS (SELECT DISTINCT a.doc, page, a.axis, kind, side, p1 + (spot - p0) * (q1 - p1) / (q0 - p0) AS pos, (q1 - p1) / (q0 - p0) AS slope FROM a JOIN side ON a.doc = side.doc AND a.axis = side.axis
    WHERE abs(q0 - p0) >= 0.01 AND spot BETWEEN least(p0, q0) - tol AND greatest(p0, q0) + tol AND pos > 3 AND pos < across - 3),
y AS (SELECT *, count(*) OVER (PARTITION BY doc, page, axis, kind, side) AS n FROM x WHERE NOT EXISTS (SELECT 1 FROM frame WHERE frame.doc = x.doc AND frame.axis = 1 - x.axis AND (pos <= low + 3 OR pos >= high - 3))),
w AS (SELECT l.doc, l.axis, l.kind, l.page AS a, r.page AS b, count(*) AS votes FROM y l JOIN y r ON l.doc = r.doc AND l.axis = r.axis AND l.kind = r.kind AND l.side = 'end' AND r.side = 'start' AND l.page < r.page AND abs(l.pos - r.pos) < 0.6 AND abs(l.slope - r.slope) < 0.05
    GROUP BY ALL HAVING count(*) >= 2 AND 2 * count(*) > greatest(max(l.n), max(r.n)))
SELECT doc, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CASE axis WHEN 0 THEN 260e0 ELSE 0 END AS dx, CASE axis WHEN 1 THEN 370e0 ELSE 0 END AS dy, CAST(max(votes) AS BIGINT) AS votes FROM w GROUP BY doc, axis, a, b""")
def frame_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_boundaries and seam_matches: pages clipped off their middle go on at their frames or at bands of the margin."""
    rows = rows_of(spark, sf_dir, FRAMED)
    steps = rows.select("doc").distinct().select("doc", F.explode(F.expr("array(struct(0 AS axis, 260D AS step), struct(1 AS axis, 370D AS step))")).alias("s")).select("doc", "s.*")
    found = E.seam_matches(_lines(rows.distinct()), _pages(rows), steps)
    return found.select("doc", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "dx", "dy", "votes")


#: An overview on page 1: two grids of cells of 30 x 40, with other columns and rows by supplier, a stray line, and on every seventh document one cell split in the middle.
OVERVIEW = f"""
WITH g AS (SELECT s_suppkey AS doc, grid, 2 + (s_suppkey + grid) % 3 AS cols, 1 + (s_suppkey + grid) % 2 AS rows, 50e0 + 200 * grid AS x0, 60e0 + 5 * grid AS y0 FROM {{supplier}} CROSS JOIN {_numbers(2)} AS t(grid))
SELECT doc, 1 AS page, x0 + 30 * k AS x1, y0 AS y1, x0 + 30 * k AS x2, y0 + 40 * rows AS y2 FROM g CROSS JOIN {_numbers(5)} AS t(k) WHERE k <= cols
UNION ALL SELECT doc, 1, x0, y0 + 40 * k, x0 + 30 * cols, y0 + 40 * k FROM g CROSS JOIN {_numbers(3)} AS t(k) WHERE k <= rows
UNION ALL SELECT doc, 1, 20e0, 300e0, 480e0, 300e0 FROM g WHERE grid = 0
UNION ALL SELECT doc, 1, x0 + 15, y0, x0 + 15, y0 + 40 FROM g WHERE grid = 0 AND doc % 7 = 0"""


@query(f"""
WITH f AS ({oracle(OVERVIEW)}), v AS (SELECT doc, x1 AS x, y1 AS low, y2 AS high FROM f WHERE x1 = x2), h AS (SELECT doc, y1 AS y, x1 AS low, x2 AS high FROM f WHERE y1 = y2),
p AS (SELECT a.doc, a.x AS x1, b.x AS x2, a.low AS la, a.high AS ha, b.low AS lb, b.high AS hb FROM v a JOIN v b ON a.doc = b.doc AND b.x - a.x >= 12 AND b.x - a.x <= 300 AND least(a.high, b.high) - greatest(a.low, b.low) >= 12),
s AS (SELECT p.*, h.y AS y1, lead(h.y) OVER (PARTITION BY p.doc, x1, x2, la, lb ORDER BY h.y) AS y2 FROM p JOIN h ON p.doc = h.doc AND h.low <= x1 + 1 AND h.high >= x2 - 1),
c AS (SELECT * FROM s WHERE y2 - y1 BETWEEN 12 AND 240 AND abs((x2 - x1) / (y2 - y1) - 0.75) / 0.75 <= 0.1 AND la <= y1 + 1 AND ha >= y2 - 1 AND lb <= y1 + 1 AND hb >= y2 - 1)
SELECT doc, x1, y1, x2, y2 FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc = c.doc AND abs(v.x - (x1 + x2) / 2) <= 0.1 * (x2 - x1) AND v.low <= y1 + 1 AND v.high >= y2 - 1)""")
def overview_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overview_lines and overview_cells: rectangles of a tile's shape between merged lines."""
    rows = rows_of(spark, sf_dir, OVERVIEW)
    steps = rows.select("doc").distinct().select("doc", F.lit(240.0).alias("step_x"), F.lit(320.0).alias("step_y"))
    return O.overview_cells(O.overview_lines(_lines(rows)), _pages(rows, 500.0, 400.0), steps).select("doc", "x1", "y1", "x2", "y2")


#: Links between neighbours in the rows of both grids, which are laid on the pages from the second on; every fifth document has none.
_GRIDS = """
WITH g AS (SELECT s_suppkey AS doc, 2 + s_suppkey % 3 AS c0, 1 + s_suppkey % 2 AS r0, 2 + (s_suppkey + 1) % 3 AS c1, 1 + (s_suppkey + 1) % 2 AS r1 FROM {supplier}),
s AS (SELECT doc, 0 AS grid, c0 AS cols, r0 AS rows, CAST(0 AS BIGINT) AS before FROM g UNION ALL SELECT doc, 1, c1, r1, c0 * r0 FROM g)"""
OVERVIEW_LINKS = _GRIDS + f"""
SELECT doc, CAST(2 + before + r * cols + k AS INT) AS a, CAST(3 + before + r * cols + k AS INT) AS b, 1 AS col, 0 AS row FROM s CROSS JOIN {_numbers(2)} AS t(r) CROSS JOIN {_numbers(4)} AS u(k) WHERE r < rows AND k < cols - 1 AND doc % 5 <> 0"""


@query(oracle(_GRIDS) + """
SELECT doc, CAST(2 + before AS INTEGER) AS first, CAST(1 + before + cols * rows AS INTEGER) AS last, CASE rows WHEN 1 THEN '' ELSE cols || ',' END || cols AS rows FROM s WHERE doc % 5 <> 0 AND doc % 7 <> 0""")
def overview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overview_groups and overview_blocks: both grids on the pages that their links name; a split cell or no link gives nothing."""
    rows = rows_of(spark, sf_dir, OVERVIEW)
    number = rows_of(spark, sf_dir, oracle(_GRIDS).replace("FROM supplier", "FROM {supplier}") + " SELECT doc, CAST(max(before + cols * rows) AS INT) + 2 AS n FROM s GROUP BY doc")
    pages = number.select("doc", F.explode(F.sequence(F.lit(1), "n")).alias("page")).withColumn("width", F.lit(500.0)).withColumn("height", F.lit(400.0))
    steps = number.select("doc", F.lit(240.0).alias("step_x"), F.lit(320.0).alias("step_y"))
    return O.overview_blocks(_lines(rows), pages, rows_of(spark, sf_dir, OVERVIEW_LINKS), steps, unsplit=True).select("doc", "first", "last", F.array_join("rows", ",").alias("rows"))


#: Documents of five kinds on pages of 300 x 400: tile labels; frames with lines across them; an overview and a seam at the page's edge; registration marks; equal shapes a step apart.
_SHIFT = "200e0 + doc % 7"
LAYOUTS = f"""
WITH d AS (SELECT s_suppkey AS doc, s_suppkey % 5 AS kind FROM {{supplier}}), p AS (SELECT d.*, page + 1 AS page FROM d CROSS JOIN {_numbers(6)} AS t(page)), k AS (SELECT * FROM {_numbers(3)} AS t(k)), c AS (SELECT * FROM {_CORNER})
SELECT doc, page, 12e0 + 260 * i AS x1, 10e0 AS y1, 12e0 + 260 * i AS x2, 380e0 AS y2 FROM p CROSS JOIN c WHERE kind = 1 AND j = 0
UNION ALL SELECT doc, page, 12e0, 10e0 + 370 * j, 272e0, 10e0 + 370 * j FROM p CROSS JOIN c WHERE kind = 1 AND i = 0
UNION ALL SELECT doc, page, 200e0, 40e0 + 60 * k + 11 * page, 272e0, 40e0 + 60 * k + 11 * page FROM p CROSS JOIN k WHERE kind = 1
UNION ALL SELECT doc, page, 12e0, 29e0 + 60 * k + 11 * page, 60e0, 29e0 + 60 * k + 11 * page FROM p CROSS JOIN k WHERE kind = 1
UNION ALL SELECT doc, 1, 50e0 + 30 * k, 60e0, 50e0 + 30 * k, 140e0 FROM d CROSS JOIN k WHERE kind = 2
UNION ALL SELECT doc, 1, 50e0, 60e0 + 40 * k, 110e0, 60e0 + 40 * k FROM d CROSS JOIN k WHERE kind = 2
UNION ALL SELECT doc, 2, 250e0, 100e0 + 50 * k, 300e0, 100e0 + 50 * k FROM d CROSS JOIN k WHERE kind = 2
UNION ALL SELECT doc, 3, 0e0, 100e0 + 50 * k, 40e0, 100e0 + 50 * k FROM d CROSS JOIN k WHERE kind = 2
UNION ALL SELECT doc, page, 15e0 + i * (250 + doc % 11), 15e0 + j * 340, 15e0 + i * (250 + doc % 11), 25e0 + j * 340 FROM p CROSS JOIN c WHERE kind = 3 AND page < 4
UNION ALL SELECT doc, page, 10e0 + i * (250 + doc % 11), 20e0 + j * 340, 20e0 + i * (250 + doc % 11), 20e0 + j * 340 FROM p CROSS JOIN c WHERE kind = 3 AND page < 4
UNION ALL SELECT doc, page, 220e0 + 20 * k - ({_SHIFT}) * (page - 1), 100e0 + 40 * k, 235e0 + 30 * k - ({_SHIFT}) * (page - 1), 130e0 + 55 * k FROM p CROSS JOIN k WHERE kind = 4 AND page < 3"""


@query("""
WITH d AS (SELECT s_suppkey AS doc, s_suppkey % 5 AS kind FROM supplier)
SELECT doc, CASE kind WHEN 1 THEN 260e0 WHEN 3 THEN 250e0 + doc % 11 WHEN 4 THEN 200e0 + doc % 7 ELSE 300e0 END AS step_x, CASE kind WHEN 1 THEN 370e0 WHEN 3 THEN 340e0 ELSE 400e0 END AS step_y,
    CASE kind WHEN 0 THEN '1-6:' || CASE WHEN doc % 2 = 0 THEN '3,3' ELSE '2,2,2' END WHEN 1 THEN '1-6:6' WHEN 2 THEN '2-5:2,2' WHEN 3 THEN '1-1:1 2-2:1 3-3:1 4-4:1 5-5:1 6-6:1' ELSE '1-2:2' END AS blocks,
    CASE kind WHEN 0 THEN 'source.pageSize source.labels' WHEN 1 THEN 'source.frame source.seams' WHEN 2 THEN 'source.pageSize source.seams source.overview' WHEN 3 THEN 'source.frame source.manual' ELSE 'source.samePaths source.pageSize' END AS sources, kind <> 3 AS confident FROM d""")
def layout_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect_layout over documents that each need another source."""
    lines = _lines(rows_of(spark, sf_dir, LAYOUTS))
    doc = F.col("s_suppkey")
    pages = D.table(spark, sf_dir, "supplier").select(doc.alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("page")).withColumn("width", F.lit(_WIDE)).withColumn("height", F.lit(_HIGH))
    across = F.when(F.col("doc") % 2 == 0, 3).otherwise(2)
    label = F.concat(F.char((65 + F.floor((F.col("page") - 1) / across)).cast("long")), ((F.col("page") - 1) % across + 1).cast("string"))
    texts = pages.where("doc % 5 = 0").select("doc", "page", label.alias("str"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(8.0).alias("height"))
    got = Y.detect_layout(lines, texts, pages)
    written = F.transform("blocks", lambda b: F.concat(b["first"].cast("string"), F.lit("-"), b["last"].cast("string"), F.lit(":"), F.array_join(b["rows"], ",")))
    return got.select("doc", r6("step_x").alias("step_x"), r6("step_y").alias("step_y"), F.array_join(written, " ").alias("blocks"), F.array_join("sources", " ").alias("sources"), "confident")


@query(_with(D.PIECES_SQL, tail="""
SELECT piece_id, CAST(1 AS BIGINT) AS outlines, h + CASE WHEN piece_id % 4 = 0 THEN 4 ELSE 0 END AS height FROM d_piece"""))
def notched_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with triangles drawn on their upper edge: marks of 0.5 cm2 go, a point of 8 cm2 belongs to the piece."""
    rows = D.pieces(spark, sf_dir).withColumn("outline", D.rectangle(F.col("w"), F.col("h")))
    big = F.col("piece_id") % 4 == 0
    at, half, tall = F.col("w") / 2, F.when(big, 2.0).otherwise(0.5), F.when(big, 4.0).otherwise(1.0)
    tooth = F.array(F.array(at - half, F.col("h")), F.array(at, F.col("h") + tall), F.array(at + half, F.col("h")))
    drawn = rows.select("piece_id", F.explode(F.array(F.concat("outline", F.slice("outline", 1, 1)), tooth)).alias("points"))
    lines = drawn.select(F.col("piece_id").cast("string").alias("doc"), F.lit("uni").alias("size"), "points", F.lit(0.1).alias("width"))
    traced = V.trace_sizes(lines, cm_per_pt=1.0, pixel_mm=2.0)
    return traced.groupBy(F.col("doc").cast("long").alias("piece_id")).agg(F.count("*").alias("outlines"), F.round(F.max(G.bbox("ring")["height"] - 0.2)).alias("height"))


@query("""
WITH d AS (SELECT s_suppkey AS doc, 10 + s_suppkey % 9 AS a, 6 + s_suppkey % 7 AS b FROM supplier)
SELECT CAST(doc AS VARCHAR) AS doc, CASE WHEN a * 10 > b * 12 OR doc % 4 = 0 THEN 'stroke:1' ELSE 'stroke:2' END AS style, 'uni' AS size FROM d WHERE a * 10 > 2 * b * 12 OR b * 12 > 2 * a * 10 OR doc % 4 = 0""")
def suggested_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suggest_assignments: two styles draw a rectangle each in centimetres; every fourth sheet leaves the second one open."""
    k = F.col("s_suppkey")
    base = D.table(spark, sf_dir, "supplier").select(k.alias("doc"), (10 + k % 9).cast("double").alias("a"), (6 + k % 7).cast("double").alias("b"))

    def drawn(style: str, w: F.Column, h: F.Column, x: float, shut: F.Column) -> DataFrame:
        left = F.lit(x)
        ring = F.array(F.array(left, F.lit(0.0)), F.array(left + w, F.lit(0.0)), F.array(left + w, h), F.array(left, h))
        return base.select("doc", F.when(shut, ring).otherwise(F.slice(ring, 1, 3)).alias("points"), shut.alias("closed"), F.lit(style).alias("style"), F.lit(0.1).alias("width"))

    # the open style of a fourth sheet encloses nothing, so the first is alone
    rows = drawn("stroke:1", F.col("a"), F.lit(10.0), 0.0, F.lit(True)).union(drawn("stroke:2", F.col("b"), F.lit(12.0), 30.0, F.col("doc") % 4 != 0))
    return V.suggest_assignments(rows, base.select("doc", F.lit(1.0).alias("cm_per_pt")))


@query(_with(D.PIECES_SQL, tail="""
, q AS (SELECT *, 0.61e0 * h AS up, CASE WHEN 0.05e0 * w <= 2 THEN 0.8e0 ELSE 0.1625e0 END AS share FROM d_piece), l AS (SELECT *, share * w AS level FROM q)
SELECT piece_id, CASE WHEN piece_id % 4 = 0 AND level >= 1.5 THEN 0e0 WHEN up >= 3 AND (up > level OR level < 3 OR share < 0.25) THEN 90e0 WHEN level >= 3 AND share >= 0.25 THEN 0e0 END AS angle FROM l"""))
def grain_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detect_grain: an upright and a level line cross each rectangle, the level one in dashes whose gaps are joined up to 2 cm; every fourth piece has a text at it, and a smaller size's outline runs inside."""
    rows = D.pieces(spark, sf_dir).select(F.col("piece_id").cast("string").alias("doc"), F.lit(1).alias("piece"), D.rectangle(F.col("w"), F.col("h")).alias("outline"), "w", "h", "piece_id")
    w, h = F.col("w"), F.col("h")

    def at(x: float, y: float) -> F.Column:
        return F.array(w * x, h * y)

    dashes = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.array(F.array(w * (0.1 + k * 0.2125), h * 0.4), F.array(w * (0.1 + k * 0.2125 + 0.1625), h * 0.4)))
    drawn = F.concat(F.array(F.array(at(0.3, 0.2), at(0.3, 0.81))), dashes, F.array(F.array(at(0.9, 0.05), at(0.9, 0.95))))
    lines = rows.select("doc", F.explode(drawn).alias("points"), F.lit(False).alias("closed"))
    texts = rows.where("piece_id % 4 = 0").select("doc", F.lit("grain line").alias("str"), (w * 0.85).alias("x"), (h * 0.4).alias("y"), F.lit(0.0).alias("height"), F.lit(0.0).alias("angle"))
    cuts = rows.select("doc", "piece", F.array(at(0.05, 0.05), at(0.9, 0.05), at(0.9, 0.95), at(0.05, 0.95)).alias("ring"))
    found = N.with_grain(rows.select("doc", "piece", "outline"), lines, texts, 1.0, cuts)
    angle = G.axis_angle(F.col("grain")[0], F.col("grain")[1])
    return found.select(F.col("doc").cast("long").alias("piece_id"), r6(F.when(angle > 179.9, 0.0).otherwise(angle)).alias("angle"))


#: Half an hour of waiting, ten minutes of lateness.
_WAIT_MS, _LATE = 1_800_000, "10 minutes"


def change_events(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))


@query(f"""
WITH e AS (SELECT user_id AS key, event_id AS event, epoch_us(ts) AS at_us, ts, event_type AS kind FROM events),
g AS (SELECT *, lead(at_us) OVER (PARTITION BY key ORDER BY at_us, event) AS following, lag(at_us) OVER (PARTITION BY key ORDER BY at_us, event) AS before FROM e),
r AS (SELECT *, sum(CASE WHEN at_us - before <= {_WAIT_MS}000 THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY at_us, event) AS run FROM g),
n AS (SELECT *, count(*) OVER (PARTITION BY key, run) AS changes FROM r)
SELECT key, event, at_us, changes FROM n WHERE (following IS NULL OR following - at_us > {_WAIT_MS}000) AND kind <> 'error'
    AND (at_us + {_WAIT_MS}000) // 1000 + 1 <= ((SELECT max(at_us) FROM e) - 600000000) // 1000""")
def settled_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over all events with keyed state and timers: the last change of each run of a user, how many changes it ends, runs that end in an error thrown away."""
    schema = D.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream's path may else be no single file
    folder = W.fresh_folder(R.shared_folder(spark))
    W.run_to_end(W.settled(change_events(stream), _WAIT_MS, ["error"], _LATE), folder)
    return spark.read.schema("key long, event long, ts timestamp, changes long").parquet(f"{folder}/rows").select("key", "event", F.unix_micros("ts").alias("at_us"), "changes")


#: Curves of 24 steps cut into eight strands, numbered and turned out of order, with gaps of up to 0.4; every fourth document closes its curve to a ring.
STRANDS = f"""
WITH p AS (SELECT s_suppkey AS doc, k, CASE WHEN s_suppkey % 4 = 0 THEN 24 ELSE 40 END AS around FROM {{supplier}} CROSS JOIN {_numbers(8)} AS t(k))
SELECT doc, (k * 5 + doc) % 8 AS id, (k + doc) % 2 AS turned, k * 3 + i AS step, i, (60 + doc % 7) * cos(2e0 * pi() * (k * 3 + i) / around) + CASE WHEN i = 3 THEN 0.1e0 * (doc % 5) ELSE 0e0 END AS x,
    (60 + doc % 7) * sin(2e0 * pi() * (k * 3 + i) / around) AS y
FROM p CROSS JOIN {_numbers(4)} AS u(i)"""


@query(f"""
WITH f AS ({oracle(STRANDS)}), o AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM f WINDOW w AS (PARTITION BY doc ORDER BY step, i DESC)),
u AS (SELECT doc, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) AS length FROM o GROUP BY doc)
SELECT doc, CAST(0 AS BIGINT) AS strand, 8 AS parts, {R6.format('length')} AS length, doc % 4 = 0 AS closed FROM u""")
def joined_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands come back as the curve that they were cut from."""
    rows = rows_of(spark, sf_dir, STRANDS).groupBy("doc", "id").agg(F.max("turned").alias("turned"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("points"))
    rows = rows.select("doc", F.col("id").cast("long").alias("id"), F.when(F.col("turned") == 1, F.reverse("points")).otherwise(F.col("points")).alias("points"))
    found = X.joined_strands(rows, 0.5)
    return found.select("doc", "strand", "parts", r6(S.polyline_length("points")).alias("length"), "closed")


#: Three to five strokes side by side over three tiles, bent once by document; every third document has a stroke that turns back.
BUNDLES = f"""
WITH p AS (SELECT s_suppkey AS doc, j, i, 20e0 * i + 0.7e0 * j AS x, 100e0 + 6 * j + (s_suppkey % 7) * 0.5e0 * i + CASE WHEN i > 3 THEN 4e0 * (i - 3) ELSE 0e0 END AS y
    FROM {{supplier}} CROSS JOIN {_numbers(5)} AS t(j) CROSS JOIN {_numbers(7)} AS u(i) WHERE j < 3 + s_suppkey % 3)
SELECT a.doc, CAST(a.j AS BIGINT) AS id, CAST(floor(a.i / 2) AS INT) AS tile, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.doc = b.doc AND a.j = b.j AND b.i = a.i + 1
UNION ALL SELECT doc, CAST(j AS BIGINT), 9, x, y, x - 30, y + 9 FROM p WHERE i = 6 AND j = 0 AND doc % 3 = 0"""


@query(f"""
WITH f AS ({oracle(BUNDLES)}), m AS (SELECT doc, min(least(x1, x2)) AS low FROM f GROUP BY doc), k AS (SELECT unnest(range(0, 60)) AS k),
s AS (SELECT f.doc, k, low + 3 * k AS x, id, y1 + (y2 - y1) * (low + 3 * k - x1) / (x2 - x1) AS y FROM f JOIN m ON f.doc = m.doc JOIN k ON 3 * k >= least(x1, x2) - low AND 3 * k <= greatest(x1, x2) - low),
e AS (SELECT doc, k, x, id, min(y) AS lo, max(y) AS hi FROM s GROUP BY ALL)
SELECT doc, CAST(k AS BIGINT) AS k, {R6.format('min(lo)')} AS low, {R6.format('avg((lo + hi) / 2)')} AS middle, {R6.format('max(hi)')} AS high, count(*) AS strokes FROM e GROUP BY doc, k, x""")
def bundle_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """envelope and centerline of bundles of strokes, split over tiles."""
    rows = rows_of(spark, sf_dir, BUNDLES).select("doc", "id", F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("points"))
    return U.stations(rows).select("doc", "k", r6("low").alias("low"), r6("middle").alias("middle"), r6("high").alias("high"), "strokes")
