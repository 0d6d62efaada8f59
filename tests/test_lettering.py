"""Lettering, notches and suggested styles on planted sheets."""

import numpy as np
import pytest

from selvage.functions import kernels as K
from selvage.operators import lettering as T
from selvage.operators import tracing as V

SUB = "doc string, path long, sub int, points array<array<double>>, style string"


def box(x, y, w=6.0, h=8.0, n=8):
    ring = [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
    return ring + [[x, y + h * k / 10] for k in range(1, n - 3)]


def left(spark, rows):
    return sorted({r["path"] for r in T.without_lettering(spark.createDataFrame([("d", *r) for r in rows], SUB)).collect()})


def test_words_go_and_marks_stay(spark):
    word = [(k, 0, box(10.0 + 8 * k, 10.0), "fill:0,0,0:0:") for k in range(5)]
    dot, far_dot, other = (20, 0, box(21.0, 12.0, 1.0, 1.0, 4), "fill:0,0,0:0:"), (21, 0, box(21.0, 60.0, 1.0, 1.0, 4), "fill:0,0,0:0:"), (22, 0, box(21.0, 12.0, 1.0, 1.0, 4), "fill:1,0,0:0:")
    dashes = [(30, k, box(12.0 + 9 * k, 14.0, 5.0, 1.0), "fill:0,0,0:0:") for k in range(3)]
    stroke, large = (40, 0, box(12.0, 11.0), "stroke:0,0,0:1:"), (41, 0, box(12.0, 11.0, 25.0), "fill:0,0,0:0:")
    assert left(spark, [*word, dot, far_dot, other, *dashes, stroke, large]) == [21, 22, 30, 40, 41]


def test_three_glyphs_are_no_lettering(spark):
    assert left(spark, [(k, 0, box(10.0 + 8 * k, 10.0), "fill:0,0,0:0:") for k in range(3)]) == [0, 1, 2]


def test_copies_count_and_empty_sheets(spark):
    copies = [(k, 0, box(10.0, 10.0), "fill:0,0,0:0:") for k in range(4)]
    assert left(spark, copies) == []
    assert left(spark, [(1, 0, [], "fill:0,0,0:0:")]) == [1]
    assert T.without_lettering(spark.createDataFrame([], SUB)).count() == 0


def square(w, h):
    return np.array([[0, 0], [w, 0], [w, h], [0, h], [0, 0]], float)


@pytest.mark.parametrize("tooth, stays", [([[4.6, 10], [5, 11], [5.4, 10]], False), ([[3, 10], [5, 14], [7, 10]], True), ([[4.6, 10], [5, 9], [5.4, 10]], None)])
def test_notches(tooth, stays):
    """A small mark outside is cut off, a large point and a mark inside belong to the piece."""
    shapes = V.trace([square(10, 10), np.array(tooth, float)], [0.1, 0.1], 1.0, 1.0)
    assert len(shapes) == 1
    height = max(y for _, y in shapes[0]["ring"])
    assert height == pytest.approx(14 if stays else 10, abs=0.25)
    assert abs(K.signed_area(shapes[0]["ring"])) == pytest.approx(108 if stays else 100, rel=0.05)


def test_border_table():
    cells = np.array([[1, 1, 2], [1, 1, 0]])
    size, inner, rim = V.border_table(cells)
    assert size[1:].tolist() == [4, 1] and inner[1:].tolist() == [1, 1] and rim[1:].tolist() == [7, 3]
    assert V.notch_cells(cells, 2).tolist() == [2]
    assert V.notch_cells(cells, 9).tolist() == []  # all cells would go
