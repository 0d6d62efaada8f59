import numpy as np
import pytest

from selvage.functions import kernels as K
from selvage.operators import tracing as R

CM = 2.54 / 72


def square(side, x=0.0, y=0.0, gap=0.0):
    p = [(x, y), (x + side, y), (x + side, y + side), (x, y + side), (x, y + gap)]
    return np.array(p)


def test_square_area():
    [shape] = R.trace([square(400)], [0.5], CM)
    assert abs(K.signed_area(shape["ring"])) == pytest.approx(400 * 400, rel=0.01)
    assert len(shape["cells"]) == 1


def test_circle_area():
    t = np.linspace(0, 2 * np.pi, 200)
    [shape] = R.trace([np.stack([200 + 150 * np.cos(t), 200 + 150 * np.sin(t)], 1)], [0.5], CM)
    assert abs(K.signed_area(shape["ring"])) == pytest.approx(np.pi * 150**2, rel=0.015) and K.is_simple(shape["ring"])


def test_gap_is_closed_only_if_asked():
    assert R.trace([square(400, gap=8)], [0.5], CM) == []
    [shape] = R.trace([square(400, gap=8)], [0.5], CM, gap_mm=4)
    assert abs(K.signed_area(shape["ring"])) == pytest.approx(400 * 400, rel=0.02)


def test_cells_share_a_border():
    [shape] = R.trace([square(400), np.array([(200.0, 0.0), (200.0, 400.0)])], [0.5, 0.5], CM)
    assert [c["area"] for c in shape["cells"]] == pytest.approx([80_000, 80_000], rel=0.02)
    [(a, b, shared)] = shape["borders"]
    assert (a, b) == (1, 2) and shared == pytest.approx(400, rel=0.02)


def test_tiny_cells_join_their_neighbour():
    [shape] = R.trace([square(400), square(10, 100, 100)], [0.5, 0.5], CM)
    assert len(shape["cells"]) == 1


def test_separate_pieces():
    assert len(R.trace([square(200), square(150, 400, 50)], [0.5, 0.5], CM)) == 2


def test_labels_equal_flood():
    draw = np.random.default_rng(3)
    for diagonal in (False, True):
        m = draw.random((25, 30)) < 0.5
        got, n = R.labels(m, diagonal)
        want, k = np.zeros(m.shape, int), 0
        for y, x in zip(*np.nonzero(m)):
            if not want[y, x]:
                k += 1
                stack = [(y, x)]
                want[y, x] = k
                while stack:
                    a, b = stack.pop()
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p, q = a + dy, b + dx
                            if (diagonal or not dy * dx) and 0 <= p < 25 and 0 <= q < 30 and m[p, q] and not want[p, q]:
                                want[p, q] = k
                                stack.append((p, q))
        assert n == k and (got == want).all()


def test_disk_equals_definition():
    draw = np.random.default_rng(4)
    m = draw.random((15, 17)) < 0.1
    y, x = np.indices(m.shape)
    want = np.zeros_like(m)
    for a, b in zip(*np.nonzero(m)):
        want |= (y - a) ** 2 + (x - b) ** 2 <= 9
    assert (R.disk(m, 3) == want).all()
    assert (R.disk(~m, 3, grow=False) == ~want).all()


def test_too_large_sheet():
    with pytest.raises(K.GeometryError, match="tooLarge"):
        R.trace([square(60_000)], [0.5], CM)


def test_grouped(spark):
    rows = [("d", s, [list(map(float, p)) for p in square(n)], 0.5) for s, n in (("S", 200), ("M", 300))]
    got = R.trace_sizes(spark.createDataFrame(rows, "doc string, size string, points array<array<double>>, width double"), CM).collect()
    assert {r["size"]: round(r["area"] ** 0.5 / 10) for r in got} == {"S": 20, "M": 30}
