"""JSON documents: patterns, the workspace and backups, with bad rows kept aside.

Reading is permissive: a file that can't be parsed or breaks a rule becomes an
error row and never stops the others.  Writing upserts by id.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import geometry as G
from selvage.functions import kernels as K

FORMAT = "selvage-pattern@1"
BACKUP_FORMAT = "selvage-backup@1"

_RING = T.ArrayType(T.ArrayType(T.DoubleType()))
SHAPE = T.StructType([T.StructField("outline", _RING), T.StructField("fold", _RING), T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("area", T.DoubleType())])
CUT = T.StructType([T.StructField("material", T.StringType()), T.StructField("count", T.DoubleType())])
PIECE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("cut", T.ArrayType(T.StructType([
        T.StructField("material", T.StringType()), T.StructField("count", T.IntegerType())]))), T.StructField("optional", T.BooleanType()),
    T.StructField("variant", T.StringType()), T.StructField("variantGroup", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("seamAllowance", T.StringType()), T.StructField("sizes", T.MapType(T.StringType(), SHAPE))])
PATTERN = T.StructType([
    T.StructField("format", T.StringType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("notes", T.StringType()), T.StructField("seamAllowance", T.StringType()),
    T.StructField("sizes", T.ArrayType(T.StringType())), T.StructField("pieces", T.ArrayType(PIECE))])
ORDER_LINE = T.StructType([
    T.StructField("line_id", T.StringType()), T.StructField("pattern_id", T.StringType()), T.StructField("size", T.StringType()), T.StructField("quantity", T.IntegerType()),
    T.StructField("include", T.MapType(T.StringType(), T.BooleanType())), T.StructField("rotations", T.MapType(T.StringType(), T.StringType()))])
#: Counts are read as doubles, so that a fraction is seen and refused.
_LOOSE = T.StructType([
    T.StructField(f.name, T.ArrayType(T.StructType([T.StructField(g.name, T.ArrayType(CUT) if g.name == "cut" else g.dataType) for g in PIECE.fields])) if f.name == "pieces" else f.dataType)
    for f in PATTERN.fields])

# What a document may hold.
SEAMS = ("included", "none", "mixed", "unknown")
ROTATIONS = ("none", "180", "90")
LONGEST_TEXT = 2000
RESERVED = "__proto__"
MAX_COUNT = 1000
POINTS = (3, 10_000)


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.char_length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def bad_text(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "") | (utf16_length(text) > LONGEST_TEXT)


def bad_key(text: Column) -> Column:
    return bad_text(text) | (text == RESERVED)


def bad_number(x: Column, positive: bool = False) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) > 1e9) | ((x <= 0) if positive else F.lit(False))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def are_simple(rings: pd.Series) -> pd.Series:
    """For each list of rings, which of them don't touch themselves."""
    return pd.Series([None if own is None else [r is not None and len(r) >= 3 and all(p is not None and len(p) == 2 for p in r) and K.is_simple(K.as_ring(r)) for r in own] for own in rings])


# Columns of its result stay columns: a Python function can't be evaluated inside a lambda.
are_simple = are_simple.asNondeterministic()


@F.pandas_udf(T.BooleanType())
def is_simple(ring: pd.Series) -> pd.Series:
    return pd.Series([r is not None and len(r) >= 3 and K.is_simple(K.as_ring(r)) for r in ring], dtype=bool)


def shape_code(shape: Column, simple: Column) -> Column:
    """Code of the first rule that a piece's shape in one size breaks."""
    ring, fold = shape["outline"], shape["fold"]
    a, b = F.get(fold, F.lit(0)), F.get(fold, F.lit(1))
    length = G.distance(a, b)
    bad_point = F.exists(ring, lambda p: (F.size(p) != 2) | bad_number(p[0]) | bad_number(p[1]))
    sides = F.transform(ring, lambda p: G.cross(a, b, p) / length)
    crossing = F.exists(sides, lambda s: s > G.FOLD_TOLERANCE_CM) & F.exists(sides, lambda s: s < -G.FOLD_TOLERANCE_CM)
    along = F.transform(F.sequence(F.lit(0), F.lit(32)), lambda i: F.array(a[0] + (b[0] - a[0]) * i / 32, a[1] + (b[1] - a[1]) * i / 32))
    off = ~F.forall(along, lambda p: G.ring_distance(p, ring) <= G.FOLD_TOLERANCE_CM)
    return (
        F.when(shape.isNull(), "pattern.expectedObject").when(ring.isNull() | (F.size(ring) == 0), "pattern.expectedList").when(bad_point, "pattern.expectedNumber")
        .when(~F.size(ring).between(*POINTS), "pattern.outlineInvalid").when((G.area(ring) < 1e-8) | ~simple, "pattern.outlineInvalid")
        .when((F.size(shape["bbox"]) != 2) | shape["bbox"].isNull(), "pattern.pointCoords").when((shape["bbox"][0] <= 0) | (shape["bbox"][1] <= 0), "pattern.sizeDimensions")
        .when(bad_number(shape["area"], True), "pattern.expectedPositive")
        .when(fold.isNotNull() & (F.size(fold) != 2), "pattern.foldPoints").when(fold.isNotNull() & (length < 1e-6), "pattern.foldZero")
        .when(fold.isNotNull() & (crossing | off), "pattern.foldEdge"))


def parse_patterns(texts: DataFrame, column: str = "value", accepted: str = FORMAT) -> tuple[DataFrame, DataFrame]:
    """Valid patterns, and ``doc, code`` of the others, from one JSON document in each row.  Unknown fields are dropped."""
    rows = texts.withColumn("doc", F.xxhash64(column)).withColumn("p", F.from_json(F.col(column), _LOOSE, {"mode": "PERMISSIVE"}))
    p = F.col("p")
    pieces = p["pieces"]
    names = F.transform(pieces, lambda x: x["id"])
    head = (
        F.when(p.isNull() | p["format"].isNull() & p["id"].isNull() & pieces.isNull(), "pattern.expectedObject").when(F.coalesce(p["format"] != accepted, F.lit(True)), "pattern.format")
        .when(p["sizes"].isNull() | (F.size(p["sizes"]) == 0), "pattern.expectedList").when(F.exists(p["sizes"], bad_key), "pattern.expectedText")
        .when(F.size(F.array_distinct(p["sizes"])) != F.size(p["sizes"]), "pattern.duplicateSize").when(pieces.isNull() | (F.size(pieces) == 0), "pattern.expectedList")
        .when(F.exists(pieces, lambda x: bad_key(x["id"]) | bad_text(x["name"])), "pattern.expectedText")
        .when(F.exists(pieces, lambda x: x["cut"].isNull() | (F.size(x["cut"]) == 0)), "pattern.expectedList")
        .when(F.exists(pieces, lambda x: F.exists(x["cut"], lambda c: bad_key(c["material"]))), "pattern.expectedText")
        .when(F.exists(pieces, lambda x: F.exists(x["cut"], lambda c: bad_number(c["count"], True))), "pattern.expectedPositive")
        .when(F.exists(pieces, lambda x: F.exists(x["cut"], lambda c: (c["count"] != F.floor(c["count"])) | (c["count"] > MAX_COUNT))), "pattern.copyCount")
        .when(F.exists(pieces, lambda x: x["sizes"].isNull() | (F.size(x["sizes"]) == 0) | (F.size(F.array_except(F.map_keys(x["sizes"]), p["sizes"])) > 0)), "pattern.pieceSizes")
        .when(F.exists(pieces, lambda x: x["seamAllowance"].isNotNull() & ~x["seamAllowance"].isin(*SEAMS)), "pattern.seamInvalid")
        .when(F.size(F.array_distinct(names)) != F.size(names), "pattern.duplicateId")
        .when(bad_key(p["id"]) | bad_text(p["name"]), "pattern.expectedText").when(p["seamAllowance"].isNull() | ~p["seamAllowance"].isin(*SEAMS), "pattern.seamInvalid"))
    rows = rows.withColumn("head", head)
    # the shapes of all pieces in order of piece and size, judged within the row: nothing is parsed twice or shuffled
    each = F.flatten(F.transform(pieces, lambda x: F.transform(F.array_sort(F.map_keys(x["sizes"])), lambda s: F.element_at(x["sizes"], s))))

    # lists of empty lists alone crash the transfer to Python, so a ring stands in where there is none to judge
    stand_in = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))

    def whole(shape: Column) -> Column:  # only pairs of numbers go to Python; what lacks some is bad whatever it says
        pairs = F.filter(shape["outline"], lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
        return F.when(F.size(pairs) > 0, pairs).otherwise(stand_in)

    rows = rows.withColumn("shapes", F.when(F.col("head").isNull(), each)).withColumn("simple", are_simple(F.coalesce(F.transform("shapes", whole), F.array(stand_in))))
    codes = F.array_compact(F.transform("shapes", lambda s, i: shape_code(s, F.get("simple", i))))
    judged = rows.withColumn("code", F.coalesce("head", F.get(codes, F.lit(0))))
    good = judged.where("code IS NULL").select("p.*")
    cut = F.transform("pieces", lambda x: x.withField("cut", F.transform(x["cut"], lambda c: F.struct(c["material"].alias("material"), c["count"].cast("int").alias("count")))))
    return good.withColumn("pieces", cut), judged.where("code IS NOT NULL").select("doc", "code")


def read_patterns(spark: SparkSession, path: str, accepted: str = FORMAT) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files under a path, one document each."""
    return parse_patterns(spark.read.text(path, wholetext=True), accepted=accepted)


def piece_problems(patterns: DataFrame) -> DataFrame:
    """``id, piece, size, kind, code`` of each shape that breaks a rule; ``fold`` if the same shape without its fold is fine."""
    rows = patterns.select("id", F.explode("pieces").alias("piece")).select("id", F.col("piece.id").alias("piece"), F.explode("piece.sizes").alias("size", "shape"))
    simple = is_simple("shape.outline")
    plain = F.col("shape").withField("fold", F.lit(None).cast(_RING))
    rows = rows.withColumn("simple", simple)
    rows = rows.withColumn("code", shape_code(F.col("shape"), F.col("simple"))).withColumn("without", shape_code(plain, F.col("simple")))
    kind = F.when(F.col("without").isNull(), "fold").when(F.col("code") == "pattern.outlineInvalid", "outline").otherwise("other")
    return rows.where("code IS NOT NULL").select("id", "piece", "size", kind.alias("kind"), "code")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; the last of several new ones wins."""
    rows = old.withColumn("_age", F.lit(0).cast("long")).unionByName(new.withColumn("_age", F.monotonically_increasing_id() + 1), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("_age"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_age")


def delete(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


WORKSPACE = T.StructType([
    T.StructField("order", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("patternId", T.StringType()), T.StructField("size", T.StringType()), T.StructField("quantity", T.DoubleType()),
        T.StructField("include", T.MapType(T.StringType(), T.BooleanType())), T.StructField("rotations", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("fabrics", T.MapType(T.StringType(), T.StructType([
        T.StructField("width", T.DoubleType()), T.StructField("length", T.DoubleType()), T.StructField("folded", T.BooleanType()), T.StructField("directional", T.BooleanType())])))])


def workspace_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """Usable order lines of workspace documents; lines without ids or with a quantity out of range are dropped, unknown rotations cleared."""
    w = texts.select(F.from_json(column, WORKSPACE).alias("w")).select(F.explode("w.order").alias("o")).select("o.*")
    ok = ~bad_text(F.col("id")) & ~bad_text(F.col("patternId")) & ~bad_text(F.col("size")) & F.col("quantity").between(1, 100) & (F.col("quantity") == F.floor("quantity"))
    return w.where(ok).select(
        F.col("id").alias("line_id"), F.col("patternId").alias("pattern_id"), "size", F.col("quantity").cast("int").alias("quantity"),
        F.coalesce("include", F.expr("CAST(map() AS map<string,boolean>)")).alias("include"),
        F.coalesce(F.map_filter("rotations", lambda k, v: v.isin(*ROTATIONS)), F.expr("CAST(map() AS map<string,string>)")).alias("rotations"))


def workspace_fabrics(texts: DataFrame, column: str = "value") -> DataFrame:
    w = texts.select(F.from_json(column, WORKSPACE).alias("w")).select(F.explode("w.fabrics").alias("material", "f"))
    return w.where(~bad_number(F.col("f.width"), True)).select(
        "material", "f.width", "f.length", F.coalesce("f.folded", F.lit(False)).alias("folded"), F.coalesce("f.directional", F.lit(False)).alias("directional"))


def is_backup(column: Column | str, accepted: str = BACKUP_FORMAT) -> Column:
    return F.coalesce(F.get_json_object(column, "$.format") == accepted, F.lit(False))


def export_backup(patterns: DataFrame, lines: DataFrame, created: str, demo_id: str = "sample", name: str = BACKUP_FORMAT) -> DataFrame:
    """One JSON document of all patterns but the sample, and the order: a document by nature, so it has to fit into memory."""
    p = patterns.where(F.col("id") != demo_id).agg(F.sort_array(F.collect_list(F.to_json(F.struct(*patterns.columns)))).alias("ps"))
    o = lines.agg(F.sort_array(F.collect_list(F.to_json(F.struct(F.col("line_id").alias("id"), F.col("pattern_id").alias("patternId"), "size", "quantity", "include", "rotations")))).alias("os"))
    head = F.concat(F.lit(f'{{"format":"{name}","created":"{created}","patterns":['), F.array_join("ps", ","), F.lit('],"workspace":{"order":['), F.array_join("os", ","), F.lit("]}}"))
    return p.crossJoin(o).select(head.alias("value"))


def parse_backup(texts: DataFrame, column: str = "value", accepted: str = FORMAT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Patterns, errors, and the order lines whose pattern survived."""
    docs = texts.where(is_backup(F.col(column)))
    each = docs.select(F.explode(F.from_json(F.get_json_object(column, "$.patterns"), "array<variant>")).alias("v")).select(F.to_json("v").alias("value"))
    good, bad = parse_patterns(each, "value", accepted)
    lines = workspace_lines(docs.select(F.get_json_object(column, "$.workspace").alias("value")))
    return good, bad, lines.join(good.select(F.col("id").alias("pattern_id")).distinct(), "pattern_id", "left_semi")
