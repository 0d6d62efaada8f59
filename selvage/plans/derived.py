"""Derived fixtures: pieces, orders and fabrics computed from the retail tables.

They are synthetic stand-ins, as no patterns come with the test data: a part's
key makes a piece's shape, a line item is an order line, its return flag is the
material and its quantity the number of copies.  They carry no meaning from the
retail schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``piece_id, shape, w, h, outline, rotation``: an L, a trapezoid or a rectangle for each part."""
    i = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        i.alias("piece_id"), (i % 3).cast("int").alias("shape"), (5 + (i * 17) % 56).cast("double").alias("w"), (5 + (i * 23) % 56).cast("double").alias("h"))
    zero = F.lit(0.0)
    w, h = F.col("w"), F.col("h")

    def ring(*points):
        return F.array(*(F.array(x, y) for x, y in points))

    outline = F.when(F.col("shape") == 0, ring((zero, zero), (w, zero), (w, h * 0.4), (w * 0.4, h * 0.4), (w * 0.4, h), (zero, h))).when(
        F.col("shape") == 1, ring((zero, zero), (w, zero), (w * 0.8, h), (w * 0.15, h))).otherwise(ring((zero, zero), (w, zero), (w, h), (zero, h)))
    return rows.withColumn("outline", outline).withColumn("rotation", F.when(F.col("piece_id") % 2 == 1, "90").otherwise("180"))


def rectangle(w, h):
    """A ring from zero."""
    zero = F.lit(0.0)
    return F.array(*(F.array(x, y) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))))


PIECES_SQL = """
d_piece AS (
    SELECT p_partkey AS piece_id, CAST(p_partkey % 3 AS INTEGER) AS shape, CAST(5 + (p_partkey * 17) % 56 AS DOUBLE) AS w, CAST(5 + (p_partkey * 23) % 56 AS DOUBLE) AS h,
        CASE WHEN p_partkey % 2 = 1 THEN '90' ELSE '180' END AS rotation
    FROM part
), d_ring AS (
    SELECT *, CASE shape
        WHEN 0 THEN [[0e0, 0e0], [w, 0e0], [w, h * 0.4e0], [w * 0.4e0, h * 0.4e0], [w * 0.4e0, h], [0e0, h]]
        WHEN 1 THEN [[0e0, 0e0], [w, 0e0], [w * 0.8e0, h], [w * 0.15e0, h]]
        ELSE [[0e0, 0e0], [w, 0e0], [w, h], [0e0, h]] END AS outline
    FROM d_piece
)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``run_id, line_id, piece_id, copies, material``; lines are numbered by all columns that tell them apart."""
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.row_number().over(own).alias("line_id"), F.col("l_partkey").alias("piece_id"),
        F.col("l_quantity").cast("int").alias("copies"), F.col("l_returnflag").alias("material"))


LINES_SQL = """
d_line AS (
    SELECT l_orderkey AS run_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_id,
        l_partkey AS piece_id, CAST(l_quantity AS INTEGER) AS copies, l_returnflag AS material
    FROM lineitem
)"""


def fabrics(spark: SparkSession) -> DataFrame:
    """Material N is missing on purpose: the default applies."""
    return spark.createDataFrame(
        [("A", 150.0, None, False, False), ("R", 140.0, None, True, False)], "material string, width double, length double, folded boolean, directional boolean")


FABRICS_SQL = "d_fabric AS (SELECT * FROM (VALUES ('A', 150e0, CAST(NULL AS DOUBLE), false, false), ('R', 140e0, NULL, true, false)) t(material, width, length, folded, directional))"


def demo_pattern(spark: SparkSession, pattern_id: str = "sample") -> DataFrame:
    """The built-in sample: a bag of five pieces in one size, as a one-row pattern table."""
    from selvage.sources.documents import PATTERN

    def shape(outline: list, fold: list | None = None) -> dict:
        xs, ys = [p[0] for p in outline], [p[1] for p in outline]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(outline, outline[1:] + outline[:1]))) / 2
        return {"uni": {"outline": [[float(v) for v in p] for p in outline], "fold": fold, "bbox": [float(max(xs) - min(xs)), float(max(ys) - min(ys))], "area": float(area)}}

    def piece(pid: str, name: str, cut: dict[str, int], sizes: dict, **more) -> dict:
        return {"id": pid, "name": name, "cut": [{"material": m, "count": n} for m, n in cut.items()], "sizes": sizes} | more

    # The sample's outlines in cm.
    rows = [
        piece("body", "Body on the fold", {"outer": 1, "lining": 1}, shape([[0, 0], [18, 0], [22, 28], [18, 34], [0, 34]], [[0.0, 0.0], [0.0, 34.0]])),
        piece("handle", "Handle", {"outer": 2}, shape([[0, 0], [7, 0], [7, 48], [0, 48]])),
        piece("pocket-small", "Small pocket", {"outer": 1}, shape([[0, 0], [16, 0], [16, 14], [12, 18], [4, 18], [0, 14]]), variantGroup="Pocket", variant="Small"),
        piece("pocket-large", "Large pocket", {"outer": 1}, shape([[0, 0], [24, 0], [24, 22], [0, 22]]), variantGroup="Pocket", variant="Large"),
        piece("tab", "Tab", {"outer": 1}, shape([[0, 0], [5, 0], [5, 12], [0, 12]]), optional=True)]
    pattern = {"id": pattern_id, "name": "Sample bag", "seamAllowance": "none", "sizes": ["uni"], "pieces": rows}
    return spark.createDataFrame([pattern], PATTERN)


def demo_lines(spark: SparkSession, quantity: int, pattern_id: str = "sample", include: dict[str, bool] | None = None) -> DataFrame:
    from selvage.sources.documents import ORDER_LINE

    return spark.createDataFrame([("1", pattern_id, "uni", quantity, include or {}, {})], ORDER_LINE)
