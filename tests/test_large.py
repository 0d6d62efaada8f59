"""What lets queries run on larger tables: equal inputs are computed once, rows stay small, nothing whole goes to the driver."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from selvage.functions import kernels as K
from selvage.operators import cells as C
from selvage.operators import nesting as N
from selvage.operators import sheet as S
from selvage.operators import summary as M
from selvage.operators import tracing as V
from selvage.plans import registry, rules, sheets  # noqa: F401 (rules and sheets register their queries)


def counted(monkeypatch, where, name):
    """Arguments of the calls of a function from here on."""
    calls, real = [], getattr(where, name)
    monkeypatch.setattr(where, name, lambda *a: calls.append(a) or real(*a))
    return calls


def test_kernels_of_equal_outlines(monkeypatch):
    rules._kernels.cache_clear()
    calls = counted(monkeypatch, K, "unfold")
    rings = [((0.0, 0.0), (w, 0.0), (w, 7.0), (0.0, 7.0)) for w in (3.0, 4.0, 3.0, 3.0, 4.0)]
    got = [rules._kernels(r) for r in rings]
    assert len(calls) == 2 and got[0] == got[2] == got[3] != got[1] == got[4]


SQUARE = ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0))


def test_equal_sheets_are_traced_once(monkeypatch):
    V._traced.cache_clear()
    calls = counted(monkeypatch, V, "trace")
    got = [V._traced(((SQUARE, w),), 1.0, 2.0, 0.0, 4.0) for w in (0.1, 0.1, 0.2, 0.1)]
    assert len(calls) == 2 and got[0] is got[1] is got[3] and len(got[2]) == 1


def test_sheets_with_notches_in_one_partition(spark):
    """Many sheets of a partition, in any order of their lines, some with a line of one point."""
    tooth = lambda tall: ((4.0, 9.0), (4.5, 9.0 + tall), (5.0, 9.0))
    lines = [(str(k), "uni", [list(p) for p in points], 0.1) for k in range(60) for points in ([SQUARE, tooth(1.0 + k % 2), ((1.0, 1.0),)] if k % 3 else [tooth(1.0 + k % 2), SQUARE])]
    frame = spark.createDataFrame(lines, "doc string, size string, points array<array<double>>, width double").repartition(3)
    got = {r["doc"]: (r["outline_id"], r["area"]) for r in V.trace_sizes(frame, 1.0, 2.0).collect()}
    alone = {k: V.trace([SQUARE, tooth(1.0 + k)], [0.1, 0.1], 1.0, 2.0) for k in (0, 1)}
    assert got == {str(k): (0, alone[k % 2][0]["area"]) for k in range(60)}
    plan = V.trace_sizes(frame, 1.0, 2.0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_equal_cells_are_united_once(monkeypatch):
    C._united.cache_clear()
    calls = counted(monkeypatch, C, "united")
    two = (SQUARE[:4], tuple((x + 9.0, y) for x, y in SQUARE[:4]))
    apart = (SQUARE[:4], tuple((x + 90.0, y) for x, y in SQUARE[:4]))
    got = [C._united(rings, 1.0, 1.0) for rings in (two, apart, two, apart)]
    assert len(calls) == 2 and got[0] == got[2] and got[0][1] is None and got[1] == got[3] == (None, "geom.partsDisconnected")


def sent_whole(frame):
    """Joins of the plan that send one side through the driver."""
    return [line.strip() for line in frame._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


def cell_rows(spark, shift, n=40):
    rows = spark.range(n).selectExpr("CAST(id AS string) AS outline", "'s' AS size", "id", "CAST(5 + id % 3 AS double) AS w")
    return rows.selectExpr("outline", "size", "id", f"array(array({shift}, 0D), array(w + {shift}, 0D), array(w + {shift}, 4D), array({shift}, 4D)) AS ring")


def test_cells_are_mapped_without_a_broadcast(spark):
    got = C.map_cells(cell_rows(spark, "0D").drop("size"), cell_rows(spark, "1D"), M.intersection_area)
    assert not sent_whole(got) and got.where("id = other").count() == 40


def test_equal_pairs_have_one_common_area(monkeypatch):
    M._common_area.cache_clear()
    calls = counted(monkeypatch, K, "intersection_area")
    other = tuple((x + 4.0, y) for x, y in SQUARE[:4])
    assert [M._common_area(SQUARE[:4], q) for q in (other, SQUARE[:4], other)] == [45.0, 81.0, 45.0] and len(calls) == 2


def test_overlaps_of_equal_outlines(spark, monkeypatch):
    """Many rings and references at few places: each pair of places is compared once, the smallest of equal references counts."""
    box = lambda x: [[x, 0.0], [x + 8.0, 0.0], [x + 8.0, 8.0], [x, 8.0]]
    rings = spark.createDataFrame([(k, box(20.0 * (k % 3))) for k in range(300)], "id long, outline array<array<double>>")
    refs = spark.createDataFrame([(1000 - k, box(20.0 * (k % 3) + 1.0)) for k in range(300)], "id long, outline array<array<double>>")
    pairs = spark.sparkContext.accumulator(0)

    def seen(a, b):
        def area(p: pd.Series, q: pd.Series) -> pd.Series:
            pairs.add(len(p))
            return pd.Series([K.intersection_area(K.as_ring(x), K.as_ring(y)) for x, y in zip(p, q)], dtype=float)

        return F.pandas_udf(area, "double")(a, b)

    got = {r["ring"]: (r["ref"], r["shared"]) for r in S.group_by_overlap(rings, refs, seen).collect()}
    assert got == {k: ({0: 703, 1: 702, 2: 701}[k % 3], 56.0) for k in range(300)} and pairs.value < 100


def test_taps_and_segments_of_one_place(spark):
    """Equal taps on equal segments don't multiply."""
    taps = spark.range(2000).selectExpr("id AS tap", "id % 2 AS doc", "5D AS x", "2D AS y", "6D AS tolerance")
    lines = spark.range(2000).selectExpr("id % 2 AS doc", "1 AS page", "concat('s', id % 3) AS owner", "array(0D, 0D) AS a", "array(10D, 0D) AS b")
    got = S.nearest_segment(taps, lines)
    assert not sent_whole(got) and {tuple(r) for r in got.select("tap", "owner", "distance").collect()} == {(k, "s0", 2.0) for k in range(2000)}


def test_furniture_of_equal_shapes(spark):
    """Frames that nearly coincide on the pages go, the many equal shapes of one page stay."""
    rows = spark.range(1200).selectExpr("id % 2 AS doc", "CAST(id % 4 DIV 2 + 1 AS int) AS page", "id AS path", "0 AS sub", "array(array(id % 2 + 0.1D * (id % 4 DIV 2), 1D), array(9D, 9D)) AS points")
    other = spark.range(500).selectExpr("id % 2 AS doc", "1 AS page", "5000 + id AS path", "0 AS sub", "array(array(50D, 1D), array(59D, 9D)) AS points")
    pages = spark.range(8).selectExpr("id % 2 AS doc", "CAST(id DIV 2 + 1 AS int) AS page").where("page < 3")
    got = S.content(rows.union(other), pages)
    assert not sent_whole(got) and got.groupBy("doc").count().orderBy("doc").collect() == [(0, 250), (1, 250)]
    assert S.furniture(rows.union(other), pages).count() == 1200


@pytest.mark.parametrize("name", ["lettering_removed", "chain_order", "grain_angles", "built_patterns"])
def test_no_table_is_sent_whole(spark, small, name):
    """Small tables too: what Spark takes for small by its files is no measure of what the driver would hold."""
    assert not [join for join in sent_whole(registry.QUERIES[name](spark, small)) if "BroadcastHashJoin" in join]


@pytest.mark.parametrize("name,shuffles", [("order_cuts", 2), ("order_piece_counts", 2)])
def test_order_lines_are_shuffled_once(spark, small, name, shuffles):
    """Lines and patterns are dealt out by pattern; what a line cuts is decided in its row."""
    plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == shuffles


def test_equal_small_markers_are_nested_once(monkeypatch):
    N._nested.cache_clear()
    calls = counted(monkeypatch, N, "nest")
    pieces = [[N.Piece(f"{k}:{i}", [(0.0, 0.0), (w, 0.0), (w, 30.0), (0.0, 30.0)]) for i, w in enumerate((100.0, 60.0))] for k in range(3)]
    options = N.Options(gap=0.0, resolution=1.0)
    got = [N.nested(p, N.Fabric(140.0), options)[1] for p in pieces]
    assert len(calls) == 1 and [[x.key for x in r.placements] for r in got] == [[f"{k}:0", f"{k}:1"] for k in range(3)] and got[0].used_length == 60.0
    narrow = N.nested(pieces[0], N.Fabric(80.0), options)[1]
    assert narrow.unplaced == ["0:0"] and len(calls) == 2


def test_markers_without_their_copies(spark, small):
    copies = registry.single_copies(spark, small).where("run_id < 30")
    whole = N.markers(N.nest_copies(copies, registry.OPTIONS))
    got = N.nest_markers(copies, registry.OPTIONS)
    assert got.columns == whole.columns and sorted(got.collect()) == sorted(whole.collect()) and not sent_whole(registry.single_copies(spark, small))[1:]
