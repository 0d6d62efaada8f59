"""Cells of a traced outline as a graph: connectivity, owners of small cells, levels and chains.

``cells(outline, id, area)`` and ``borders(outline, a, b, shared)`` hold any
number of outlines; a border is listed from both sides.  Small cells are given
away in rounds of joins over all outlines; the graph of what is left is an array
of neighbours for each outline, and distances in it are a fold over levels.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import geometry as G
from selvage.functions import kernels as K
from selvage.operators import rounds as R
from selvage.operators.groups import by_group, dealt

# Fixed values of the domain.
CELL_MIN_CM2 = 3.0
BORDER_MIN_MM = 2.0
START_SHARE = 0.5


def connected(cells: DataFrame, borders: DataFrame, selected: DataFrame) -> DataFrame:
    """``outline, connected``: the selected cells of each outline hang together; ids that don't exist are ignored."""
    nodes = cells.join(dealt(selected.select("outline", "id").distinct()), ["outline", "id"]).select(F.col("outline").alias("doc"), "id")
    ends = [nodes.select("doc", F.col("id").alias(c)) for c in "ab"]
    links = borders.where("shared > 0").select(F.col("outline").alias("doc"), "a", "b").join(dealt(ends[0]), ["doc", "a"], "left_semi").join(dealt(ends[1]), ["doc", "b"], "left_semi")
    groups = R.components(nodes, links)
    return groups.groupBy(F.col("doc").alias("outline")).agg((F.min("root") == F.max("root")).alias("connected"))


def owners(cells: DataFrame, borders: DataFrame, least_area: float) -> DataFrame:
    """``outline, id, owner``: small cells follow their longest border, again and again, to a large one.

    A way never comes back to a cell; where it can't go on, it ends.  In a round
    all ways go one step; of equal borders the one to the smaller id counts.
    """
    area = cells.select("outline", F.col("id").alias("at"), "area")
    known = borders.join(cells.select("outline", F.col("id").alias("b")), ["outline", "b"], "left_semi").select("outline", F.col("a").alias("at"), "b", "shared")
    ways = R.written(cells.select("outline", "id", F.col("id").alias("at"), F.array("id").alias("past")), "ways")
    ended = ways.where("false")
    while True:
        small = ways.join(area.where(F.col("area") < least_area), ["outline", "at"], "left_semi")
        on = small.join(known, ["outline", "at"]).where(~F.array_contains("past", F.col("b"))).groupBy("outline", "id").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("to"))
        on = R.written(on, "steps")
        ended = ended.union(ways.join(on, ["outline", "id"], "left_anti"))
        if on.isEmpty():
            return ended.select("outline", "id", F.col("at").alias("owner"))
        ways = R.written(ways.join(on, ["outline", "id"]).select("outline", "id", F.col("to").alias("at"), F.concat("past", F.array("to")).alias("past")), "ways")


def absorbed(cells: DataFrame, borders: DataFrame, cm_per_pt: float) -> DataFrame:
    """``outline, id, head``: large cells are heads of their own; the others join the head beyond their longest border to a cell that has one."""
    big = F.col("area") * cm_per_pt**2 >= CELL_MIN_CM2
    state = R.written(cells.select("outline", "id", F.when(big, F.col("id")).alias("head")), "heads")
    beside = borders.where("shared > 0").select("outline", F.col("a").alias("id"), "b", "shared")
    while True:
        given = state.where("head IS NOT NULL").select("outline", F.col("id").alias("b"), F.col("head").alias("to"))
        new = state.where("head IS NULL").join(dealt(beside), ["outline", "id"]).join(dealt(given), ["outline", "b"]).groupBy("outline", "id").agg(F.max_by("to", F.struct("shared", -F.col("b"))).alias("to"))
        new = R.written(new, "absorbed")
        if new.isEmpty():
            return state.where("head IS NOT NULL")
        before = state
        state = R.written(state.join(dealt(new), ["outline", "id"], "left").select("outline", "id", F.coalesce("head", "to").alias("head")), "heads")
        R.remove(before, new)


def _graph(cells: DataFrame, borders: DataFrame, cm_per_pt: float) -> tuple[DataFrame, DataFrame]:
    """``outline, id, head``, and a row for each outline: ``heads array<struct<n, head, size, near>>``, where ``near`` holds the places of a head's neighbours in it."""
    owner = absorbed(cells, borders, cm_per_pt)
    sizes = owner.join(dealt(cells.select("outline", "id", "area")), ["outline", "id"]).groupBy("outline", "head").agg(F.sum("area").alias("size"))
    heads = R.written(sizes.withColumn("n", F.row_number().over(Window.partitionBy("outline").orderBy("head")) - 1), "numbered-heads")
    wide = borders.where((F.col("shared") * cm_per_pt * 10 >= BORDER_MIN_MM) & (F.col("a") != F.col("b"))).select("outline", F.col("a").alias("head"), "b").distinct()
    wide = wide.join(dealt(heads.select("outline", "head", "n")), ["outline", "head"]).join(dealt(heads.select("outline", F.col("head").alias("b"), F.col("n").alias("m"))), ["outline", "b"])
    beside = wide.groupBy("outline", "head").agg(F.array_sort(F.collect_list("m")).alias("near"))
    each = heads.join(dealt(beside), ["outline", "head"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<int>")))
    return owner, each.groupBy("outline").agg(F.array_sort(F.collect_list(F.struct("n", "head", "size", "near"))).alias("heads"))


def _levels(start: Column) -> Column:
    """``array<struct<n, level>>`` of what can be reached from a place in ``heads``: neighbours of a level that are neither in it nor in the one before make the next."""
    none = F.array().cast("array<int>")
    state = F.struct(none.alias("before"), F.array(start).alias("now"), F.array(F.struct(start.alias("n"), F.lit(0).alias("level"))).alias("all"))

    def next_level(s: Column, k: Column) -> Column:
        near = F.array_distinct(F.flatten(F.transform(s["now"], lambda h: F.get("heads", h)["near"])))
        new = F.array_except(F.array_except(near, s["now"]), s["before"])
        return F.struct(s["now"].alias("before"), new.alias("now"), F.concat(s["all"], F.transform(new, lambda h: F.struct(h.alias("n"), k.alias("level")))).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.size("heads")), state, next_level)["all"]


def _spread(owner: DataFrame, graph: DataFrame, start: Column, name: str) -> DataFrame:
    """Levels from a head as a row for each cell, where they reach all heads."""
    found = graph.withColumn("start", start).where("start IS NOT NULL").withColumn("levels", _levels(F.col("start"))).where(F.size("levels") == F.size("heads"))
    named = F.transform("levels", lambda l: F.struct(F.get("heads", l["n"])["head"].alias("head"), l["level"].alias("level")))
    rows = found.select("outline", F.explode(named).alias("l")).select("outline", "l.head", F.col("l.level").alias(name))
    return owner.join(dealt(rows), ["outline", "head"]).select("outline", "id", name)


def _largest(heads: Column) -> Column:
    """``struct<less, n>`` of the head of the largest size, of equals the smallest id."""
    return F.array_min(F.transform(heads, lambda h: F.struct((-h["size"]).alias("less"), h["n"].alias("n"))))


def onion_levels(cells: DataFrame, borders: DataFrame, cm_per_pt: float) -> DataFrame:
    """``outline, id, level``: distance from the largest cell; outlines that aren't connected have no rows."""
    owner, graph = _graph(cells, borders, cm_per_pt)
    return _spread(owner, graph, _largest(F.col("heads"))["n"], "level")


def chain_order(cells: DataFrame, borders: DataFrame, cm_per_pt: float) -> DataFrame:
    """``outline, id, step`` where the cells form a path whose larger end isn't a small cell.

    A graph with two ends and otherwise two neighbours each is a path if its
    levels from one end reach everything.
    """
    owner, graph = _graph(cells, borders, cm_per_pt)
    ends = F.filter("heads", lambda h: F.size(h["near"]) == 1)
    path = (F.size(ends) == 2) & F.forall("heads", lambda h: F.size(h["near"]).between(1, 2))
    first, most = _largest(ends), -_largest(F.col("heads"))["less"]
    return _spread(owner, graph, F.when(path & (-first["less"] >= START_SHARE * most), first["n"]), "step")


def grid_like(cells: DataFrame, spread: float = 1.15, least: int = 4, cover: float = 0.8) -> DataFrame:
    """``outline, grid``: four cells or more of about one area that cover most of it."""
    every = cells.groupBy("outline").agg(F.array_sort(F.collect_list("area")).alias("areas"))
    total = F.aggregate("areas", F.lit(0.0), lambda s, a: s + a)
    near = F.transform("areas", lambda a: F.filter("areas", lambda b: (b >= a) & (b <= a * spread)))
    hit = F.exists(near, lambda g: (F.size(g) >= least) & (F.aggregate(g, F.lit(0.0), lambda s, a: s + a) > cover * total))
    return every.select("outline", hit.alias("grid"))


def map_cells(chosen: DataFrame, cells: DataFrame, overlap) -> DataFrame:
    """``outline, size, id, other``: each chosen cell's counterpart in another size, the cell that shares most with it, if that is half of the smaller.

    ``chosen(outline, id, ring)`` of the reference size and ``cells(outline,
    size, id, ring)``; ``overlap`` is a column function of both rings.
    """
    ref = chosen.select("outline", F.col("id").alias("ref"), F.col("ring").alias("r1"), G.bbox("ring").alias("b1"), G.area("ring").alias("a1"))
    own = cells.select("outline", "size", "id", "ring", G.bbox("ring").alias("b2"), G.area("ring").alias("a2"))
    near = ref.join(dealt(own), "outline").where((F.col("b1.min_x") < F.col("b2.max_x")) & (F.col("b2.min_x") < F.col("b1.max_x")) & (F.col("b1.min_y") < F.col("b2.max_y")) & (F.col("b2.min_y") < F.col("b1.max_y")))
    near = near.withColumn("shared", overlap("r1", "ring")).where((F.col("shared") > 0) & (2 * F.col("shared") >= F.least("a1", "a2")))
    best = near.groupBy("outline", "size", "ref").agg(F.max_by("id", F.struct("shared", -F.col("id"))).alias("other"))
    return best.select("outline", "size", F.col("ref").alias("id"), "other")


def single_cell(rings: DataFrame) -> DataFrame:
    """An outline as its only cell."""
    return rings.select("outline", F.lit(1).cast("long").alias("id"), "ring", G.area("ring").alias("area"))


#: Rings run through pixel centres: grown by a little more than half a pixel, neighbours overlap.
GROWN_PIXELS = 0.6


def united(rings: list[K.Ring], cm_per_pt: float, pixel_mm: float) -> K.Ring:
    grown = GROWN_PIXELS * pixel_mm / 10 / cm_per_pt
    try:
        return K.union(*(K.offset(r, grown) for r in rings))
    except K.GeometryError as e:
        raise K.GeometryError("geom.partsDisconnected") from e


#: Outlines of more points are united each time, as what is remembered has to stay small.
REMEMBERED_POINTS = 1000
_UNITED = T.StructType([T.StructField("outline", T.StringType()), T.StructField("ring", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("error", T.StringType())])


@lru_cache(maxsize=4096)
def _united(rings: tuple, cm_per_pt: float, pixel_mm: float) -> tuple[K.Ring | None, str | None]:
    """The ring of equal cells, or the code of what is wrong with them."""
    try:
        return united([list(r) for r in rings], cm_per_pt, pixel_mm), None
    except K.GeometryError as e:
        return None, str(e)


def union_cells(cells: DataFrame, cm_per_pt: float, pixel_mm: float) -> DataFrame:
    """``outline, ring, error``: the cells of each outline as one ring; the error's code where they fall apart."""
    def run(own: list[dict]) -> list[tuple]:
        rings = tuple(sorted(tuple(K.as_ring(r["ring"])) for r in own))
        few = sum(map(len, rings)) <= REMEMBERED_POINTS
        return [(own[0]["outline"], *(_united if few else _united.__wrapped__)(rings, cm_per_pt, pixel_mm))]

    return by_group(cells.select("outline", "ring"), ["outline"], run, _UNITED)


def nested_outlines(cells: DataFrame, borders: DataFrame, count: int, cm_per_pt: float, pixel_mm: float) -> DataFrame:
    """``outline, level, ring``: the union of all cells up to each level, for outlines with as many levels as sizes.

    An outline with one level is the same in every size: its row has level 0 and
    no ring.  Outlines whose levels don't match, or fall apart, have no rows.
    """
    levels = onion_levels(cells, borders, cm_per_pt)
    number = levels.groupBy("outline").agg(F.count_distinct("level").alias("n"), F.min("level").alias("first"))
    single = number.where("n = 1").select("outline", F.lit(0).alias("level"), F.lit(None).cast("array<array<double>>").alias("ring"))
    fit = levels.join(number.where((F.col("n") == count) & (F.col("n") > 1)), "outline").select("outline", "id", (F.col("level") - F.col("first") + 1).alias("level"))
    upto = fit.join(cells.select("outline", "id", "ring"), ["outline", "id"]).withColumn("at", F.explode(F.sequence(F.col("level"), F.lit(count))))
    named = upto.select(F.concat_ws("\0", "outline", F.col("at").cast("string")).alias("outline"), "id", "ring")
    rings = union_cells(named, cm_per_pt, pixel_mm).select(F.substring_index("outline", "\0", 1).alias("outline"), F.substring_index("outline", "\0", -1).cast("int").alias("level"), "ring", "error")
    bad = rings.where("error IS NOT NULL").select("outline").distinct()
    return rings.join(bad, "outline", "left_anti").select("outline", "level", "ring").union(single)


def propose_chain(cells: DataFrame, borders: DataFrame, cm_per_pt: float, option: str = "Option") -> DataFrame:
    """``piece, variant, label, size, cells``: where every size's cells form a path of one length, variants are the path's beginnings.

    ``cells`` and ``borders`` have the columns of :func:`chain_order` and in
    ``outline`` the piece and the size, joined by U+0000.
    """
    sizes = cells.select("outline").distinct()
    steps = chain_order(cells, borders, cm_per_pt).groupBy("outline").agg(F.max("step").alias("last"), F.collect_list(F.struct("step", "id")).alias("path"))
    every = sizes.join(steps, "outline", "left").withColumn("piece", F.substring_index("outline", "\0", 1)).withColumn("size", F.substring_index("outline", "\0", -1))
    same = every.groupBy("piece").agg(F.min("last").alias("lo"), F.max("last").alias("hi"), F.count_if(F.col("last").isNull()).alias("none")).where("none = 0 AND lo = hi").select("piece")
    rows = every.join(same, "piece").withColumn("variant", F.explode(F.sequence(F.lit(1), F.col("last") + 1)))
    chosen = F.transform(F.filter(F.array_sort("path"), lambda s: s["step"] < F.col("variant")), lambda s: s["id"])
    return rows.select("piece", "variant", F.concat(F.lit(option + " "), F.col("variant").cast("string")).alias("label"), "size", chosen.alias("cells"))
