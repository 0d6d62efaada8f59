"""What to say about finished markers, and manual moves in them."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import geometry as G
from selvage.functions import kernels as K

# Fabric is sold by this length; moves are tried on this grid.
BUY_ROUNDING_CM = 5
TOLERANCE = 1e-6


def length_to_buy(used: Column | str) -> Column:
    used = F.col(used) if isinstance(used, str) else used
    return F.greatest(F.lit(0), F.ceil(used / BUY_ROUNDING_CM - 1e-9)) * BUY_ROUNDING_CM


def fabric_summary(markers: DataFrame) -> DataFrame:
    """``material, code, n, metres, width, exact, left`` from ``material, width, length, folded, copies, placed, unplaced, used_length``.

    A marker without result (``used_length`` null) is being computed; one with
    nothing to say has no row.
    """
    open_ended, missed = F.col("length").isNull(), F.coalesce("unplaced", F.lit(0)) > 0
    pending = F.col("used_length").isNull()
    empty = (F.col("copies") == 0) & (F.coalesce("placed", F.lit(0)) == 0) & ~missed & (F.coalesce("used_length", F.lit(0.0)) == 0)
    code = (
        F.when(pending & (F.col("copies") > 0), "summary.computing").when(pending | empty, None)
        .when(open_ended & missed, F.when(F.col("folded"), "summary.tooWideFolded").otherwise("summary.tooWide"))
        .when(open_ended, F.when(F.col("folded"), "summary.buyFolded").otherwise("summary.buy"))
        .when(missed, "summary.noFit").otherwise("summary.fits"))
    buy = F.col("code").startswith("summary.buy")
    return markers.withColumn("code", code).where("code IS NOT NULL").select(
        "material", "code", F.when(F.col("code").isin("summary.tooWide", "summary.tooWideFolded", "summary.noFit"), F.col("unplaced")).alias("n"),
        F.when(buy, G.js_round(length_to_buy("used_length").cast("double")) / 100).alias("metres"), F.when(buy, G.js_round(F.col("width"), 1)).alias("width"),
        F.when(buy, G.js_round(F.col("used_length"), 1)).alias("exact"),
        F.when(F.col("code") == "summary.fits", F.greatest(F.lit(0.0), F.floor(F.col("length") - F.col("used_length")).cast("double"))).alias("left"))


def placed_sentence(placed: Column | str, total: Column | str) -> Column:
    placed, total = (F.col(c) if isinstance(c, str) else c for c in (placed, total))
    return F.when(total - placed <= 0, "summary.placedAll").otherwise("summary.placedPartial")


def orientation(mirrored: Column, angle: Column, flip_y: Column) -> Column:
    """``mirrored, turn`` as seen on the table: flipping over counts as a half turn of the mirrored piece."""
    return F.struct((mirrored != flip_y).alias("mirrored"), ((angle + F.when(flip_y, 180).otherwise(0)) % 360).alias("turn"))


def piece_table(placed: DataFrame, copies: DataFrame) -> DataFrame:
    """Placed copies with their labels' parts and rounded positions; copies that were left have no position."""
    labels = copies.select("material", "key", "label", F.col("mirrored").alias("is_mirrored"))
    rows = placed.join(labels, ["material", "key"], "left")
    parts = F.split("label", " · ")
    turn = orientation(F.coalesce("is_mirrored", F.lit(False)), F.coalesce("angle", F.lit(0)), F.coalesce("flip_y", F.lit(False)))
    return rows.select(
        "run_id", "material", "key", "placed", parts[0].alias("pattern"), parts[1].alias("piece"), parts[2].alias("size"),
        G.js_round(F.col("x"), 1).alias("x"), G.js_round(F.col("y"), 1).alias("y"), turn["mirrored"].alias("mirrored"), turn["turn"].alias("turn"))


def recompute(placed: DataFrame, copies: DataFrame) -> DataFrame:
    """``run_id, material, used_length, utilization`` of placements after moves."""
    areas = copies.select("material", "key", G.area("polygon").alias("own"), "width", "folded")
    rows = placed.where("placed").join(areas, ["material", "key"])
    out = rows.groupBy("run_id", "material").agg(
        F.max(F.array_max(G.ys("polygon"))).alias("used_length"), F.sum("own").alias("filled"), (F.max("width") / F.when(F.max("folded"), 2).otherwise(1)).alias("usable"))
    size = F.col("usable") * F.col("used_length")
    return out.select("run_id", "material", "used_length", (F.col("filled") / F.when(size == 0, 1.0).otherwise(size)).alias("utilization"))


@F.pandas_udf(T.DoubleType())
def polygon_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([K.polygon_distance(K.as_ring(p), K.as_ring(q)) for p, q in zip(a, b)], dtype=float)


#: Pairs of more points are computed each time, as what is remembered has to stay small.
REMEMBERED_POINTS = 1000


@lru_cache(maxsize=16384)
def _common_area(p: tuple, q: tuple) -> float:
    """Equal pairs of outlines share their area."""
    return K.intersection_area(list(p), list(q))


@F.pandas_udf(T.DoubleType())
def intersection_area(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = ((tuple(K.as_ring(p)), tuple(K.as_ring(q))) for p, q in zip(a, b))
    return pd.Series([(_common_area if len(p) + len(q) <= REMEMBERED_POINTS else _common_area.__wrapped__)(p, q) for p, q in pairs], dtype=float)


def try_moves(placed: DataFrame, copies: DataFrame, moves: DataFrame, gap: float) -> DataFrame:
    """``run_id, material, key, ok, reason, blocked_by, dx, dy`` for ``moves(run_id, material, key, dx, dy)``.

    Positions snap to a millimetre.  Bounding boxes are compared in the join,
    exact distances only for what they let through.
    """
    keys = ["run_id", "material"]
    fabric = copies.select("material", "key", "fold_edge", "width", "length", "folded")
    box = placed.where("placed").select(*keys, "key", "polygon", G.bbox("polygon").alias("b"))
    rows = moves.join(box, [*keys, "key"], "left").join(fabric, ["material", "key"], "left")

    def snapped(from_: Column, by: Column) -> Column:
        return F.when(F.abs(by) < TOLERANCE, 0.0).otherwise(G.js_round(from_ + by, 1) - from_)

    rows = rows.withColumn("sx", snapped(F.col("b.min_x"), F.col("dx"))).withColumn("sy", snapped(F.col("b.min_y"), F.col("dy")))
    rows = rows.withColumn("to", G.translate("polygon", F.col("sx"), F.col("sy"))).withColumn("t", G.bbox("to"))
    usable = F.col("width") / F.when(F.col("folded"), 2).otherwise(1)
    low = F.when(F.col("folded") & ~F.col("fold_edge"), gap / 2).otherwise(0.0)
    outside = (
        (F.col("t.min_x") < low - TOLERANCE) | (F.col("t.max_x") > usable + TOLERANCE) | (F.col("t.min_y") < -TOLERANCE)
        | F.coalesce(F.col("t.max_y") > F.col("length") + TOLERANCE, F.lit(False)))
    reason = F.when(F.col("polygon").isNull() | ~F.coalesce(F.abs("dx") < float("inf"), F.lit(False)) | ~F.coalesce(F.abs("dy") < float("inf"), F.lit(False)), "bounds").when(
        F.col("fold_edge") & (F.col("sx") != 0), "fold").when(outside, "bounds")
    rows = rows.withColumn("reason", reason)
    other = box.select(*keys, F.col("key").alias("other"), F.col("polygon").alias("its"), F.col("b").alias("o"))
    near = rows.where("reason IS NULL").join(other, keys).where(
        (F.col("key") != F.col("other")) & (F.col("o.min_x") <= F.col("t.max_x") + gap) & (F.col("o.max_x") >= F.col("t.min_x") - gap)
        & (F.col("o.min_y") <= F.col("t.max_y") + gap) & (F.col("o.max_y") >= F.col("t.min_y") - gap))
    near = near.where(polygon_distance("to", "its") < gap - TOLERANCE).groupBy(*keys, "key").agg(F.array_sort(F.collect_list("other")).alias("blocked_by"))
    out = rows.join(near, [*keys, "key"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("blocked_by").isNotNull(), "gap")))
    return out.select(*keys, "key", F.col("reason").isNull().alias("ok"), "reason", "blocked_by", F.col("sx").alias("dx"), F.col("sy").alias("dy"))


def ticks(length: Column | str, unit: str = "cm") -> Column:
    """Ruler marks ``array<struct<at, label>>``: every 10 cm, or every 5 inches."""
    length = F.col(length) if isinstance(length, str) else length
    step, one = (10.0, 1.0) if unit == "cm" else (12.7, 2.54)
    return F.transform(F.sequence(F.lit(0), F.floor(length / step).cast("int")), lambda k: F.struct((k * step).alias("at"), G.js_round(k * step / one).cast("long").alias("label")))
