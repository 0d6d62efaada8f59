"""Scalar geometry as column expressions.

A ring is ``array<array<double>>`` of points ``[x, y]``, open (the first point
isn't repeated).  Everything is a higher-order function over the array, so it
stays inside the JVM.  Angles are in degrees, lengths in the ring's unit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of the domain.
EPS = 1e-8
FOLD_TOLERANCE_CM = 0.2

RING = "array<array<double>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xs(ring: Column | str) -> Column:
    return F.transform(_col(ring), lambda p: p[0])


def ys(ring: Column | str) -> Column:
    return F.transform(_col(ring), lambda p: p[1])


def point(x: Column, y: Column) -> Column:
    return F.array(x, y)


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up towards positive infinity, and never -0."""
    scale = 10.0**digits
    return F.floor(_col(x) * scale + 0.5) / F.lit(scale) + F.lit(0.0)


def edges(ring: Column | str) -> Column:
    """``array<struct<a, b>>`` of the closed ring; empty for an empty one."""
    r = _col(ring)
    n = F.size(r)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.element_at(r, i + 1).alias("a"), F.element_at(r, (i + 1) % n + 1).alias("b")))).otherwise(F.array().cast(f"array<struct<a:array<double>,b:array<double>>>"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def signed_area(ring: Column | str) -> Column:
    return _sum(F.transform(edges(ring), lambda e: e["a"][0] * e["b"][1] - e["b"][0] * e["a"][1])) / 2


def area(ring: Column | str) -> Column:
    return F.abs(signed_area(ring))


def bbox(ring: Column | str) -> Column:
    x, y = xs(ring), ys(ring)
    return F.struct(
        F.array_min(x).alias("min_x"), F.array_min(y).alias("min_y"), F.array_max(x).alias("max_x"), F.array_max(y).alias("max_y"),
        (F.array_max(x) - F.array_min(x)).alias("width"), (F.array_max(y) - F.array_min(y)).alias("height"))


def translate(ring: Column | str, dx: Column | float, dy: Column | float) -> Column:
    dx, dy = (v if isinstance(v, Column) else F.lit(float(v)) for v in (dx, dy))
    return F.transform(_col(ring), lambda p: point(p[0] + dx, p[1] + dy))


def normalize(ring: Column | str) -> Column:
    """The bounding box starts at the origin."""
    return translate(ring, -F.array_min(xs(ring)), -F.array_min(ys(ring)))


def rotate(ring: Column | str, degrees: Column | float) -> Column:
    a = (degrees if isinstance(degrees, Column) else F.lit(float(degrees))) * F.lit(math.pi) / F.lit(180.0)
    return F.transform(_col(ring), lambda p: point(p[0] * F.cos(a) - p[1] * F.sin(a), p[0] * F.sin(a) + p[1] * F.cos(a)))


def mirror_x(ring: Column | str) -> Column:
    return normalize(F.transform(_col(ring), lambda p: point(-p[0], p[1])))


def mirror_y(ring: Column | str) -> Column:
    return normalize(F.transform(_col(ring), lambda p: point(p[0], -p[1])))


def mirror_across(ring: Column | str, a: Column | str, b: Column | str) -> Column:
    """Reflection in the line through two points; null where they coincide."""
    a, b = _col(a), _col(b)
    dx, dy = b[0] - a[0], b[1] - a[1]
    length2 = dx * dx + dy * dy
    return F.when(length2 >= EPS, F.transform(_col(ring), lambda p: _reflected(p, a, dx, dy, length2)))


def _reflected(p: Column, a: Column, dx: Column, dy: Column, length2: Column) -> Column:
    t = ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length2
    return point(F.lit(2.0) * (a[0] + t * dx) - p[0], F.lit(2.0) * (a[1] + t * dy) - p[1])


def cross(a: Column, b: Column, c: Column) -> Column:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def distance(a: Column, b: Column) -> Column:
    return F.hypot(a[0] - b[0], a[1] - b[1])


def line_distance(p: Column, a: Column, b: Column) -> Column:
    """Distance to the infinite line."""
    return F.abs(cross(a, b, p)) / distance(a, b)


def point_segment_distance(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / F.when(length2 == 0, 1.0).otherwise(length2)))
    return F.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def ring_distance(p: Column, ring: Column | str) -> Column:
    """Smallest distance of a point to the ring's edges."""
    return F.array_min(F.transform(edges(ring), lambda e: point_segment_distance(p, e["a"], e["b"])))


def segments_intersect(a: Column, b: Column, c: Column, d: Column) -> Column:
    apart = (
        (F.greatest(a[0], b[0]) < F.least(c[0], d[0]) - EPS) | (F.greatest(c[0], d[0]) < F.least(a[0], b[0]) - EPS)
        | (F.greatest(a[1], b[1]) < F.least(c[1], d[1]) - EPS) | (F.greatest(c[1], d[1]) < F.least(a[1], b[1]) - EPS))
    return ~apart & (cross(a, b, c) * cross(a, b, d) <= 0) & (cross(c, d, a) * cross(c, d, b) <= 0)


def contains_point(ring: Column | str, x: Column | str, y: Column | str) -> Column:
    """Even-odd rule."""
    x, y = _col(x), _col(y)

    def crossed(e: Column) -> Column:
        a, b = e["b"], e["a"]
        return ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / F.when(a[1] == b[1], 1.0).otherwise(b[1] - a[1]) + a[0])

    return F.size(F.filter(edges(ring), crossed)) % 2 == 1


def centroid(ring: Column | str) -> Column:
    """Area centroid; the mean of the points where the area vanishes."""
    e = edges(ring)
    twice = signed_area(ring) * 2
    cx = _sum(F.transform(e, lambda s: (s["a"][0] + s["b"][0]) * (s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1]))) / (twice * 3)
    cy = _sum(F.transform(e, lambda s: (s["a"][1] + s["b"][1]) * (s["a"][0] * s["b"][1] - s["b"][0] * s["a"][1]))) / (twice * 3)
    n = F.size(_col(ring))
    return F.when(F.abs(twice) > 1e-12, point(cx, cy)).otherwise(point(_sum(xs(ring)) / n, _sum(ys(ring)) / n))


def open_ring(ring: Column | str) -> Column:
    """Without a repeated closing point."""
    r = _col(ring)
    return F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)


def same_outline(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """Every vertex of either ring lies within the tolerance of the other."""
    a, b = _col(a), _col(b)
    return F.forall(a, lambda p: ring_distance(p, b) <= tolerance) & F.forall(b, lambda p: ring_distance(p, a) <= tolerance)


def axis_angle(a: Column, b: Column) -> Column:
    """Undirected angle in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(b[1] - a[1], b[0] - a[0])) + F.lit(360.0), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two undirected angles."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def fold_is_vertical(a: Column, b: Column) -> Column:
    """Within a degree of vertical."""
    return F.abs(b[0] - a[0]) <= F.abs(b[1] - a[1]) * F.lit(math.tan(math.pi / 180)) + EPS


def orient_fold(ring: Column | str, a: Column | str, b: Column | str) -> Column:
    """Turned so that the fold lies on x = 0 with the piece to its right."""
    a, b = _col(a), _col(b)
    low, high = F.when(a[1] <= b[1], a).otherwise(b), F.when(a[1] <= b[1], b).otherwise(a)
    turn = F.lit(90.0) - F.degrees(F.atan2(high[1] - low[1], high[0] - low[0]))
    turned = rotate(translate(ring, -low[0], -low[1]), turn)
    side = F.when(F.abs(F.array_min(xs(turned))) > F.abs(F.array_max(xs(turned))), -1.0).otherwise(1.0)
    return normalize(F.transform(turned, lambda p: point(F.when(F.abs(p[0]) < 1e-6, 0.0).otherwise(p[0] * side), p[1])))


def one_sided(ring: Column | str, a: Column, b: Column, tolerance: float) -> Column:
    """All vertices on one side of the line through a and b."""
    length = distance(a, b)
    return F.forall(_col(ring), lambda p: cross(a, b, p) / length <= tolerance) | F.forall(_col(ring), lambda p: cross(a, b, p) / length >= -tolerance)


def affine(m: Column | str, x: Column, y: Column) -> Column:
    """A 2x3 matrix ``[a, b, c, d, e, f]`` applied to a point."""
    m = _col(m)
    return point(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])


def affine_product(m: Column | str, n: Column | str) -> Column:
    """``n`` first, then ``m``."""
    m, n = _col(m), _col(n)
    return F.array(
        m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def bezier(p0: Column, p1: Column, p2: Column, p3: Column, samples: int = 12) -> Column:
    """Points of a cubic at equal parameters, without the start."""
    def at(k: Column) -> Column:
        t = k / F.lit(float(samples))
        u = F.lit(1.0) - t
        return F.array(*(u * u * u * p0[i] + 3 * u * u * t * p1[i] + 3 * u * t * t * p2[i] + t * t * t * p3[i] for i in (0, 1)))

    return F.transform(F.sequence(F.lit(1), F.lit(samples)), at)


def stroke_metrics(ctm: Column | str, width: Column, a: Column, b: Column) -> Column:
    """``line_width, scale`` of a stroke from a to b under a matrix: the width across the tangent, and the factor of dash lengths along it."""
    m = _col(ctm)
    det = m[0] * m[3] - m[1] * m[2]
    dx, dy = b[0] - a[0], b[1] - a[1]
    inverse = F.hypot(m[3] * dx - m[2] * dy, m[0] * dy - m[1] * dx)
    scale = F.when(inverse == 0, 0.0).otherwise(F.abs(det) * F.hypot(dx, dy) / F.when(inverse == 0, 1.0).otherwise(inverse))
    return F.struct(F.when(scale == 0, 0.0).otherwise(width * F.abs(det) / F.when(scale == 0, 1.0).otherwise(scale)).alias("line_width"), scale.alias("scale"))
