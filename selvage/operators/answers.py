"""What a user types or chooses: trace options, drafts, scale answers, size chips; and errors as codes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import geometry as G
from selvage.functions import text as X
from selvage.functions.kernels import GeometryError
from selvage.operators.sheet import CM_PER_PT

# Ranges of the options; how many sizes a legend may list; words before them.
GAP_MM, PIXEL_MM = (0.0, 6.0), (0.25, 1.0)
MOST_NUMBERS, MOST_LETTERS = 14, 10
SIZE_LEAD = r"(?iu)^(?:sizes?|velikost(?:i)?|größen?|gr\.?|tailles?)\s*[:.]?\s+"


def to_note(error: Exception, fallback: str = "unknown") -> dict:
    """Code and parameters of an error of the domain; any other is the fallback."""
    if isinstance(error, GeometryError):
        return {"code": str(error), "params": getattr(error, "params", {})}
    return {"code": fallback, "params": {}}


def trace_options(gap: Column, pixel: Column, least_area: Column) -> Column:
    """``struct<gap_mm, pixel_mm, least_cm2>`` of typed texts; null if one is empty, no number or out of range."""
    def number(t: Column) -> Column:
        return F.when(X.trim(t) != "", F.regexp_replace(X.trim(t), "^([^,]*),", "$1.").try_cast("double"))

    g, p, a = number(gap), number(pixel), number(least_area)
    ok = g.between(*GAP_MM) & p.between(*PIXEL_MM) & (a >= 0) & (a < float("inf"))
    return F.when(ok, F.struct(g.alias("gap_mm"), p.alias("pixel_mm"), a.alias("least_cm2")))


def override_scale(scale: Column, square_cm: Column) -> Column:
    """The scale by the measured side of its square; null without a square or a positive side."""
    ok = (scale["measured_pt"] > 0) & (square_cm > 0) & (square_cm < float("inf"))
    return F.when(ok, F.struct((square_cm / scale["measured_pt"]).alias("cm_per_pt"), scale["source"].alias("source"), square_cm.alias("square_cm"), scale["measured_pt"].alias("measured_pt")))


def resolve_scale(scale: Column, ok: Column, measured_cm: Column, percent: Column) -> Column:
    """``struct<scale, error>`` for an answer: a percentage of the print, or the square is right, or its side as measured."""
    kind = "struct<cm_per_pt:double,source:string,square_cm:double,measured_pt:double>"
    scale = scale.cast(kind)

    def answer(value: Column | None, error: Column | str | None) -> Column:
        return F.struct((F.lit(None) if value is None else value).cast(kind).alias("scale"), (error if isinstance(error, Column) else F.lit(error)).cast("string").alias("error"))

    good = (percent > 0) & (percent < float("inf"))
    printed = F.struct((percent * CM_PER_PT / 100).alias("cm_per_pt"), scale["source"].alias("source"), scale["square_cm"].alias("square_cm"), scale["measured_pt"].alias("measured_pt"))
    measured = override_scale(scale, measured_cm)
    return F.when(percent.isNotNull() & good, answer(printed, None)).when(percent.isNotNull(), answer(None, "scale.percent")).when(ok, answer(scale, None)).when(
        ~F.coalesce(scale["measured_pt"] > 0, F.lit(False)), answer(None, "scale.squareMissing")).when(measured.isNull(), answer(None, "scale.measured")).otherwise(answer(measured, None))


def draft_problems(name: Column, cut: Column, grain: Column, variants: Column) -> Column:
    """Codes of all that is wrong with a draft; ``variants`` hold ``label``, ``cells map<size, array<id>>`` and ``split``, whether chosen cells fall apart."""
    labels = F.transform(variants, lambda v: F.lower(X.trim(v["label"])))
    named = F.filter(labels, lambda t: t != "")
    chosen = F.transform(variants, lambda v, i: F.struct(
        F.when(X.trim(v["label"]) != "", X.trim(v["label"])).otherwise((i + 1).cast("string")).alias("name"), F.exists(F.map_values(v["cells"]), lambda ids: F.size(ids) > 0).alias("some"), v["split"].alias("split")))
    of_variants = F.flatten(F.transform(chosen, lambda v: F.array_compact(F.array(
        F.when(~v["some"], F.concat(F.lit("variantEmpty:"), v["name"])).when(v["split"], F.concat(F.lit("variantSplit:"), v["name"]))))))
    own = F.array_compact(F.array(
        F.when(X.trim(name) == "", "name"), F.when(F.size(cut) == 0, "material"), F.when(F.exists(cut, lambda c: X.trim(c["material"]) == ""), "materialName"),
        F.when(F.exists(cut, lambda c: ~c["count"].between(1, 1000) | (c["count"] != F.floor(c["count"]))), "count"), F.when(grain.isNull() | F.isnan(grain) | (F.abs(grain) == float("inf")), "angle"),
        F.when(F.size(named) < F.size(labels), "variantName"), F.when(F.size(F.array_distinct(named)) < F.size(named), "variantUnique")))
    return F.concat(own, of_variants)


def _is_size(t: Column) -> Column:
    number = t.rlike(r"^\d+$")
    return t.rlike(X.SIZE_TOKEN) & (F.lower(t) != "uni") & (~t.rlike(r"^\d") | (number & t.try_cast("int").between(2, 170)))


def size_chips(texts: DataFrame) -> DataFrame:
    """``doc, sizes``: the sizes of a sheet's legend, the largest cluster of texts that are sizes only and all numbers or all letters.

    ``texts(doc, page, str, x, y, height)``.  Texts are near each other along a
    line or down a column; clusters are the components of nearness.  The texts of
    one sheet that are sizes only are few, so they are clustered in a grouped map.
    """
    words = F.filter(F.split(F.regexp_replace(X.trim("str"), SIZE_LEAD, ""), r"[\s,;]+"), lambda t: t != "")
    rows = texts.withColumn("tokens", words).where((F.size("tokens") > 0) & F.forall("tokens", _is_size))
    rows = rows.select("doc", "page", "str", "x", "y", F.greatest("height", F.lit(1.0)).alias("h"), F.transform("tokens", F.upper).alias("tokens"))

    def cluster(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["page", "y", "x", "str"]).reset_index(drop=True)
        x, y, h = (own[c].to_numpy() for c in "xyh")
        label = np.arange(len(own))
        while True:
            low = label.copy()
            for i in range(len(own)):
                high, dx, dy = np.maximum(h[i], h), np.abs(x[i] - x), np.abs(y[i] - y)
                near = (dy <= 0.4 * high) & (dx <= 10 * high) | (dx <= 2 * high) & (dy <= 3 * high)
                low[i] = label[near].min()
            if (low == label).all():
                return own.assign(i=np.arange(len(own)), c=label)[["doc", "i", "c", "tokens"]]
            label = low

    schema = T.StructType([rows.schema["doc"], T.StructField("i", T.LongType()), T.StructField("c", T.LongType()), rows.schema["tokens"]])
    found = rows.groupBy("doc").applyInPandas(cluster, schema).groupBy("doc", "c").agg(
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "tokens"))), lambda r: r["tokens"]))).alias("sizes"))
    numbers = F.size(F.filter("sizes", lambda t: t.rlike(r"^\d+$")))
    found = found.where((F.size("sizes") >= 2) & ((numbers == 0) | (numbers == F.size("sizes"))) & (F.size("sizes") <= F.when(numbers > 0, MOST_NUMBERS).otherwise(MOST_LETTERS)))
    best = found.groupBy("doc").agg(F.max_by("sizes", F.struct(F.size("sizes"), -F.col("c"))).alias("sizes"))
    return best.select("doc", X.sort_sizes("sizes").alias("sizes"))


def sheet_problem(candidates: DataFrame) -> DataFrame:
    """``doc, problem``: ``overlapping`` where outlines fall into very many cells.

    ``candidates(doc, candidate, outline_cm2, cells)``: ``cells`` is the largest
    number of cells of 3 square cm in a size.  More than 60 in one, or half of
    the area in those with more than 30, speaks of pieces drawn over each other.
    """
    total, many = F.sum("outline_cm2"), F.sum(F.when(F.col("cells") > 30, F.col("outline_cm2")).otherwise(0.0))
    return candidates.groupBy("doc").agg(F.when((F.max("cells") > 60) | ((total > 0) & (many >= 0.5 * total)), "overlapping").alias("problem"))


def path_style(paths: DataFrame) -> DataFrame:
    """``doc, path, key``: kind, colour, width and dashes of each path, as its legend entry names them.

    ``paths(doc, path, kind, color, width, dash, ctm, points, closed)`` has a row
    for each subpath.  Width and dashes are means over the drawn length, rounded
    to 0.05 and 0.5; fills have neither.
    """
    n = F.size("points")
    last = n - F.when(F.col("closed"), 0).otherwise(1)
    steps = paths.where(n >= 2).withColumn("i", F.explode(F.sequence(F.lit(0), last - 1)))
    a, b = F.get("points", F.col("i")), F.get("points", (F.col("i") + 1) % n)
    steps = steps.withColumn("len", G.distance(a, b)).withColumn("m", G.stroke_metrics("ctm", F.col("width"), a, b))
    mean = steps.groupBy("doc", "path").agg(F.first("kind").alias("kind"), F.first("color").alias("color"), F.first("dash").alias("dash"), F.sum("len").alias("all"),
                                            F.sum(F.col("m.line_width") * F.col("len")).alias("w"), F.sum(F.col("m.scale") * F.col("len")).alias("s"))
    whole = F.when(F.col("all") == 0, 1.0).otherwise(F.col("all"))

    def shown(x: Column, step: float) -> Column:
        v = F.round(F.floor(x / step + 0.5) * step, 4)
        return F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))

    stroke = F.col("kind") == "stroke"
    return mean.select("doc", "path", F.concat_ws(
        ":", "kind", F.array_join(F.transform("color", lambda c: shown(c, 1 / 255)), ","), F.when(stroke, shown(F.col("w") / whole, 0.05)).otherwise("0"),
        F.when(stroke, F.array_join(F.transform("dash", lambda d: shown(d * F.col("s") / whole, 0.5)), ",")).otherwise("")).alias("key"))
