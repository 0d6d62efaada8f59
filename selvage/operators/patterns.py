"""Whole patterns from drafts: candidate outlines, variants made of cells, and rectangles become pieces in every size.

All tables are keyed by ``doc``, so any number of documents is built at once.
The stages are joins on (document, candidate, size); only the pieces of one
pattern come together in a row, as a pattern is one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.functions import text as X
from selvage.operators import building as B
from selvage.operators import cells as C
from selvage.operators.groups import dealt
from selvage.sources import documents as J

RECTANGLES = "doc string, pos int, name string, cut array<struct<material:string,count:int>>, optional boolean, variant string, variant_group string, sizes map<string,struct<width:double,height:double>>"
_SHAPE = f"struct<outline:{G.RING},fold:{G.RING},bbox:array<double>,area:double>"


def ids_in_order(bases: Column) -> Column:
    """Each base, or with the first free suffix ``-2``, ``-3``, ... where an earlier one has that id already."""
    def step(used: Column, base: Column) -> Column:
        free = F.filter(F.sequence(F.lit(2), F.size(used) + 2), lambda n: ~F.array_contains(used, F.concat_ws("-", base, n.cast("string"))))
        other = F.concat_ws("-", base, F.element_at(free, 1).cast("string"))
        return F.concat(used, F.array(F.when(F.array_contains(used, base), other).otherwise(base)))

    return F.aggregate(bases, F.array().cast("array<string>"), step)


def _by(rows: Column, field: str) -> Column:
    return F.array_sort(rows, lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0))


def _filled(text: Column) -> Column:
    """Trimmed, null where nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def build_pattern(outlines: DataFrame, drafts: DataFrame, meta: DataFrame, cells: DataFrame, rectangles: DataFrame, cm_per_pt: float, pixel_mm: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Patterns with the columns of a pattern document beside ``doc``, and ``doc, pos, code`` of what stops one.

    ``outlines(doc, candidate, size, ring, reference)``, one reference a
    candidate; ``cells(doc, candidate, size, id, ring)``; ``meta(doc, id, name,
    author, source, seam_allowance, sizes)``; ``drafts(doc, pos, candidate, name,
    cut, grain, fold_edge, all_sizes, include, optional, variant, variant_group,
    variants)``, where ``fold_edge`` is an index (from 0, or null) into the fold
    edges of the reference and ``variants`` lists ``struct<label, cells
    map<size, array<id>>>``; ``rectangles`` as in ``RECTANGLES``.

    A document with a problem has no pattern.  Drafts that aren't included are
    left out; a draft without any size stays as a piece without sizes, and sizes
    that no piece has leave the pattern.
    """
    reference = outlines.where("reference").select("doc", "candidate", F.col("size").alias("ref_size"), F.col("ring").alias("ref_ring"))
    edged = B.with_fold_edges(reference.withColumn("outline", G.open_ring("ref_ring")), cm_per_pt).drop("outline")
    chosen = drafts.where("include").join(dealt(edged), ["doc", "candidate"], "left")
    gone = chosen.where("ref_size IS NULL").select("doc", "pos", F.lit("build.pieceGone").alias("code"))
    chosen = chosen.where("ref_size IS NOT NULL").withColumn("edge", F.get("fold_edges", F.col("fold_edge"))).drop("fold_edges")
    variants = chosen.select("*", F.posexplode_outer("variants").alias("v", "option")).drop("variants")
    variants = variants.withColumn("v", F.coalesce("v", F.lit(-1))).withColumn("label", F.trim("option.label"))
    unnamed = variants.where("v >= 0 AND coalesce(label, '') = ''").select("doc", "pos", F.lit("build.variantNoName").alias("code"))

    # a row for each piece and size it may have
    order = meta.select("doc", F.posexplode("sizes").alias("at", "size"))
    wanted = variants.select("doc", "pos", "v", "candidate", "option", "all_sizes", "ref_size", "ref_ring", "grain", "edge").join(dealt(order), "doc")
    wanted = wanted.withColumn("source", F.when(F.col("all_sizes"), F.col("ref_size")).otherwise(F.col("size")))
    own = outlines.select("doc", "candidate", F.col("size").alias("source"), "ring")
    plain = wanted.where("v < 0").join(dealt(own), ["doc", "candidate", "source"]).select("doc", "pos", "v", "at", "size", "ring", "ref_ring", "grain", "edge")

    has_outline = own.select("doc", "candidate", "source").distinct()
    joined = wanted.where("v >= 0").join(dealt(has_outline), ["doc", "candidate", "source"], "left_semi")
    ids = joined.withColumn("ids", F.array_distinct(F.element_at("option.cells", F.col("source")))).where("size(ids) > 0")
    each = ids.select("doc", "pos", "v", "candidate", "source", "at", F.explode("ids").alias("id")).join(
        dealt(cells.select("doc", "candidate", F.col("size").alias("source"), "id", "ring")), ["doc", "candidate", "source", "id"], "left")
    missing = each.where("ring IS NULL").select("doc", "pos", F.lit("build.cellMissing").alias("code"))
    key = F.concat_ws("\0", "doc", F.col("pos").cast("string"), F.col("v").cast("string"), F.col("at").cast("string"))
    united = C.union_cells(each.where("ring IS NOT NULL").select(key.alias("outline"), "id", G.open_ring("ring").alias("ring")), cm_per_pt, pixel_mm)
    formed = ids.withColumn("outline", key).join(dealt(united), "outline")
    apart = formed.where("error IS NOT NULL").select("doc", "pos", F.lit("build.variantUnion").alias("code"))
    sizeless = variants.where("v >= 0").join(dealt(ids.select("doc", "pos", "v").distinct()), ["doc", "pos", "v"], "left_anti").select("doc", "pos", F.lit("build.variantNoSizes").alias("code"))
    problems = gone.union(unnamed).union(missing).union(apart).union(sizeless).distinct()

    rings = plain.union(formed.where("error IS NULL").select(*plain.columns))
    snapped = B.with_snapped_fold(rings.withColumn("outline", G.open_ring("ring")), cm_per_pt)
    shapes = B.build_shapes(snapped.withColumn("reference", F.col("ref_ring")), cm_per_pt)
    sized = shapes.select(F.lit(0).alias("part"), "doc", "pos", "v", "at", "size", F.col("shape").cast(_SHAPE).alias("shape"))

    rect = rectangles.select("doc", "pos", F.explode("sizes").alias("size", "m")).join(dealt(order), ["doc", "size"])
    flat = B.rectangle_shape(F.col("m.width"), F.col("m.height"))
    flat = F.struct(flat["outline"].alias("outline"), F.lit(None).cast(G.RING).alias("fold"), flat["bbox"].alias("bbox"), flat["area"].alias("area"))
    sized = sized.union(rect.select(F.lit(1).alias("part"), "doc", "pos", F.lit(-1).alias("v"), "at", "size", flat.cast(_SHAPE).alias("shape")))
    sized = sized.groupBy("doc", "part", "pos", "v").agg(_by(F.collect_list(F.struct("at", "size", "shape")), "at").alias("list"))
    sized = sized.select("doc", "part", "pos", "v", F.map_from_entries(F.transform("list", lambda x: F.struct(x["size"], x["shape"]))).alias("sizes"))

    name, is_variant = F.trim("name"), F.col("v") >= 0
    bare = F.coalesce(F.nullif(X.slug("name"), F.lit("")), F.concat(F.lit("part-"), F.col("candidate").cast("string")))
    base = F.when(is_variant, F.concat_ws("-", bare, F.coalesce(F.nullif(X.slug("label"), F.lit("")), F.lit("variant")))).otherwise(bare)
    cut = F.transform("cut", lambda c: F.struct(F.trim(c["material"]).alias("material"), c["count"].cast("int").alias("count")))
    optional = F.when(F.col("optional"), F.lit(True)).alias("optional")
    heads = variants.select(
        F.lit(0).alias("part"), "doc", "pos", "v", base.alias("base"), F.when(is_variant, F.concat_ws(" – ", name, "label")).otherwise(name).alias("name"), cut.alias("cut"), optional,
        F.when(is_variant, F.col("label")).otherwise(_filled(F.col("variant"))).alias("variant"),
        F.when(is_variant, F.coalesce(_filled(F.col("variant_group")), name)).otherwise(_filled(F.col("variant_group"))).alias("variantGroup"))
    heads = heads.union(rectangles.select(
        F.lit(1), "doc", "pos", F.lit(-1), F.coalesce(F.nullif(X.slug("name"), F.lit("")), F.concat(F.lit("rectangle-"), (F.col("pos") + 1).cast("string"))), name, cut, optional,
        _filled(F.col("variant")), _filled(F.col("variant_group"))))
    whole = heads.join(dealt(sized), ["doc", "part", "pos", "v"], "left")
    none = F.lit(None).cast("string")
    piece = F.struct(
        F.col("base").alias("id"), "name", "cut", "optional", "variant", "variantGroup", none.alias("note"), none.alias("seamAllowance"),
        F.coalesce("sizes", F.expr(f"CAST(map() AS map<string,{_SHAPE}>)")).alias("sizes"))
    made = whole.groupBy("doc").agg(_by(F.collect_list(F.struct(F.struct("part", "pos", "v").alias("ord"), piece.alias("piece"))), "ord").alias("all"))
    made = made.withColumn("taken", ids_in_order(F.transform("all", lambda x: x["piece"]["id"])))
    made = made.select("doc", F.transform("all", lambda x, i: x["piece"].withField("id", F.get("taken", i))).alias("pieces"))
    out = meta.join(dealt(problems.select("doc").distinct()), "doc", "left_anti").join(dealt(made), "doc", "left")
    out = out.withColumn("pieces", F.coalesce("pieces", F.array().cast(J.PATTERN["pieces"].dataType)))
    held = F.flatten(F.transform("pieces", lambda p: F.map_keys(p["sizes"])))
    return out.select(
        "doc", F.lit(J.FORMAT).alias("format"), "id", F.trim("name").alias("name"), _filled(F.col("author")).alias("author"), F.nullif("source", F.lit("")).alias("source"), none.alias("notes"),
        F.col("seam_allowance").alias("seamAllowance"), F.filter("sizes", lambda s: F.array_contains(held, s)).alias("sizes"), "pieces"), problems
