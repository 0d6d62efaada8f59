import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selvage.functions import geometry as G
from selvage.functions import kernels as K

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
BODY = [[0.0, 0.0], [18.0, 0.0], [22.0, 28.0], [18.0, 34.0], [0.0, 34.0]]


@pytest.fixture(scope="module")
def ring(spark):
    return spark.createDataFrame([(BODY,)], f"ring {G.RING}")


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def test_area_and_box(ring):
    assert one(ring, G.area("ring")) == 680.0
    b = one(ring, G.bbox("ring"))
    assert (b["width"], b["height"]) == (22.0, 34.0)


def test_centroid_is_inside(ring):
    c = one(ring, G.centroid("ring"))
    assert one(ring, G.contains_point("ring", F.lit(c[0]), F.lit(c[1])))
    assert not one(ring, G.contains_point("ring", F.lit(-1.0), F.lit(5.0)))


def test_rotation_keeps_area(ring):
    assert one(ring, G.area(G.rotate("ring", 37))) == pytest.approx(680)
    assert one(ring, G.signed_area(G.mirror_x("ring"))) == pytest.approx(-680)


def test_rounding_is_half_up(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (-0.2,)], "x double")
    assert [r["v"] for r in df.select(G.js_round(F.col("x")).alias("v")).collect()] == [-2.0, 3.0, 0.0]


def test_empty_ring(spark):
    df = spark.createDataFrame([([],)], f"ring {G.RING}")
    assert one(df, G.signed_area("ring")) == 0.0


def test_offset_of_square():
    x0, y0, x1, y1 = K.bounds(K.offset(SQUARE, 1))
    assert (x1 - x0, y1 - y0) == (12, 12)
    assert abs(K.signed_area(K.offset(SQUARE, 1))) == pytest.approx(144)


def test_offset_of_notched_ring_stays_simple():
    ring = [(0, 0), (20, 0), (20, 8), (12, 8), (12, 7), (8, 7), (8, 20), (0, 20)]
    grown = K.offset(ring, 1)
    assert K.is_simple(grown) and abs(K.signed_area(grown)) > abs(K.signed_area(ring))


def test_spike_is_cut_off():
    assert K.bounds(K.offset([(0, 0), (10, 0), (5, 0.5)], 1))[0] > -2.5


def test_unfold_doubles():
    full = K.unfold(BODY, (0, 0), (0, 34))
    assert abs(K.signed_area(full)) == pytest.approx(1360)
    assert K.bounds(full) == (0, 0, 44, 34)


def test_union_of_parts_that_are_apart_fails():
    with pytest.raises(K.GeometryError, match="partsDisconnected"):
        K.union(SQUARE, [(x + 50, y) for x, y in SQUARE])


def test_intersection_area():
    other = [(x + 5, y + 5) for x, y in SQUARE]
    assert K.intersection_area(SQUARE, other) == pytest.approx(25)
    assert K.intersection_area(SQUARE, [(x + 10, y) for x, y in SQUARE]) == 0
    assert K.polygon_distance(SQUARE, [(x + 13, y) for x, y in SQUARE]) == 3


def test_bow_tie_is_not_simple():
    assert not K.is_simple([(0, 0), (10, 10), (10, 0), (0, 10)])
    assert K.is_simple(SQUARE)


def test_align_fold():
    ring = [(0.1, 0.0), (18.0, 0.0), (18.0, 34.0), (-0.1, 34.0)]
    out, changed = K.align_fold(ring, (0.0, 0.0), (0.0, 34.0))
    assert changed and min(x for x, _ in out) == pytest.approx(0)
    assert K.align_fold(K.as_ring(BODY), (0.0, 0.0), (0.0, 34.0))[1] is False


def test_simplify_keeps_corners():
    assert K.simplify([(0, 0), (5, 0.01), (10, 0), (10, 10)], 0.1) == [(0, 0), (10, 0), (10, 10)]


@settings(max_examples=60, deadline=None)
@given(st.integers(3, 9), st.floats(0.1, 3), st.floats(0, 6))
def test_offset_of_regular_polygon(n, d, turn):
    ring = [(10 * math.cos(turn + 2 * math.pi * k / n), 10 * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]
    grown = K.offset(ring, d)
    a, p = abs(K.signed_area(ring)), sum(math.dist(ring[i - 1], ring[i]) for i in range(n))
    assert a + p * d + math.pi * d * d - 1e-3 <= abs(K.signed_area(grown)) <= a + p * d + 6 * d * d
