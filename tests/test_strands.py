"""Strands and bundles of planted curves."""

import math
import random

import pytest

from selvage.operators import bundles as U
from selvage.operators import strands as X

STRANDS = "doc string, id long, points array<array<double>>"


def lines_of(spark, rows, reach=0.5):
    return {(r["doc"], r["strand"]): ([tuple(p) for p in r["points"]], r["parts"], r["closed"]) for r in X.joined_strands(spark.createDataFrame(rows, STRANDS), reach).collect()}


def test_shuffled_pieces_come_back_whole(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for doc, ring in (("arc", False), ("ring", True)):
        curve = [(60 * math.cos(t / 30 * math.pi), 60 * math.sin(t / 30 * math.pi)) for t in range(60 if ring else 45)]
        curve += curve[:1] if ring else []
        cuts = [0, 3, 4, 11, 20, 29, 33, len(curve) - 1]
        ids = draw.sample(range(100), len(cuts) - 1)
        for k, (a, b) in zip(ids, zip(cuts, cuts[1:])):
            part = curve[a:b + 1]
            rows.append((doc, k, [list(p) for p in (part if draw.random() < 0.5 else part[::-1])]))
        want[doc] = (min(ids), curve)
    rows += [("arc", 500, [[0.0, 0.0], [5.0, 5.0]]), ("arc", 501, [[9.0, 9.0]])]  # far from everything; a point is no strand
    got = lines_of(spark, rows)
    assert set(got) == {("arc", want["arc"][0]), ("arc", 500), ("ring", want["ring"][0])}
    points, parts, closed = got["arc", want["arc"][0]]
    assert parts == 7 and not closed and (points == want["arc"][1] or points[::-1] == want["arc"][1])
    points, parts, closed = got["ring", want["ring"][0]]
    assert parts == 7 and closed and len(points) == 61 and set(points) == set(want["ring"][1])
    assert got["arc", 500][1] == 1


def test_an_end_is_tied_once(spark):
    """Three ends meet: the two nearest are tied, the third stays free."""
    rows = [("d", 1, [[0.0, 0.0], [10.0, 0.0]]), ("d", 2, [[10.1, 0.0], [20.0, 0.0]]), ("d", 3, [[10.0, 0.3], [10.0, 9.0]])]
    got = lines_of(spark, rows)
    assert got["d", 1][1] == 2 and got["d", 3][1] == 1
    assert lines_of(spark, [("d", 1, [[0.0, 0.0], [9.0, 0.0]])])["d", 1][0] == [(0.0, 0.0), (9.0, 0.0)]


def test_centre_line_is_drawn_out(spark):
    rows = [("d", k, [[0.0, 10.0 * k], [30.0, 10.0 * k + 30.0]]) for k in range(3)] + [("d", 0, [[30.0, 30.0], [60.0, 60.0]]), ("e", 1, [[5.0, 1.0], [6.0, 1.0]]), ("f", 1, [[5.0, 1.0]])]
    found = U.stations(spark.createDataFrame(rows, STRANDS))
    at = {(r["doc"], r["k"]): r for r in found.collect()}
    assert (at["d", 5]["low"], at["d", 5]["middle"], at["d", 5]["high"], at["d", 5]["strokes"]) == (15.0, 25.0, 35.0, 3)
    assert at["d", 15]["strokes"] == 1 and ("f", 0) not in at
    lines = {r["doc"]: r["points"] for r in U.centre_lines(found, 40.0).collect()}
    assert lines["d"][0] == pytest.approx([-40 / math.sqrt(2), 10 - 40 / math.sqrt(2)]) and lines["d"][-1] == pytest.approx([60 + 40 / math.sqrt(2)] * 2)
    assert lines["e"] == [[5.0, 1.0]] * 3  # one station has no direction
