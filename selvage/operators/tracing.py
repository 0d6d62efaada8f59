"""Closed outlines from drawn lines: a raster is closed, flooded from outside and followed along its border.

One sheet and size is one group: its lines are painted into a bitmap, gaps are
bridged by growing the lines, what the flood from outside can't reach is inside,
and growing is undone at the rim.  Regions between the lines become cells that
share the lines' pixels.  Rows of a bitmap are handled as runs, so numpy does
the work for whole rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selvage.functions import kernels as K
from selvage.operators.groups import by_group

# Fixed values of the domain.
MAX_PIXELS = 40_000_000
SIMPLIFY_MM = 0.3
SMALL_CELL_CM2 = 0.3
NOTCH_CM2 = 1.0


def disk(mask: np.ndarray, radius: float, grow: bool = True) -> np.ndarray:
    """Dilation or erosion by a disk: for each row offset a horizontal window over running sums."""
    if radius <= 0:
        return mask.copy()
    source = mask if grow else ~mask
    r = int(radius)
    height, width = source.shape
    sums = np.zeros((height, width + 1), np.int32)
    np.cumsum(source, axis=1, out=sums[:, 1:])
    out = np.zeros_like(source)
    at = np.arange(width)
    for dy in range(-r, r + 1):
        half = int((radius * radius - dy * dy) ** 0.5)
        hit = sums[:, np.minimum(at + half + 1, width)] - sums[:, np.maximum(at - half, 0)] > 0
        if dy >= 0:
            out[dy:] |= hit[:height - dy]
        else:
            out[:dy] |= hit[-dy:]
    return out if grow else ~out


def labels(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Connected regions of a bitmap, numbered from 1 in reading order: runs of rows joined by union-find."""
    height, width = mask.shape
    padded = np.zeros((height, width + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    first = np.searchsorted(row, np.arange(height + 1))
    root = list(range(len(row)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    reach = 1 if diagonal else 0
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(i) for i in range(len(row))], int)
    names, number = np.unique(roots, return_inverse=True)
    marks = np.zeros((height, width + 1), np.int64)
    np.add.at(marks, (row, start), number + 1)
    np.add.at(marks, (row, end), -(number + 1))
    return np.cumsum(marks, axis=1)[:, :width], len(names)


def paint(shape: tuple[int, int], lines: list[np.ndarray], widths: list[float]) -> np.ndarray:
    """Polylines in pixels, drawn by points half a pixel apart and grown to their width."""
    out = np.zeros(shape, bool)
    for width in sorted(set(widths)):
        own = np.zeros(shape, bool)
        for line, w in zip(lines, widths):
            if w != width:
                continue
            for a, b in zip(line, line[1:]):
                n = max(1, int(np.ceil(np.abs(b - a).max() * 2)))
                p = np.rint(a + (b - a) * np.linspace(0, 1, n + 1)[:, None]).astype(int)
                own[p[:, 1], p[:, 0]] = True
        out |= disk(own, width / 2)
    return out


def border(mask: np.ndarray) -> K.Ring:
    """Outer border of the one region of a bitmap, along the edges of its pixels, counter-clockwise in a plane with y downwards."""
    padded = np.pad(mask, 1)
    y0 = int(np.argmax(padded.any(1)))
    x0 = int(np.argmax(padded[y0]))
    steps = ((1, 0), (0, 1), (-1, 0), (0, -1))  # right, down, left, up
    ahead = ((0, -1, 0, 0), (0, 0, -1, 0), (-1, 0, -1, -1), (-1, -1, 0, -1))  # pixels left and right of the edge ahead, from a corner

    def filled(x: int, y: int) -> bool:
        return bool(padded[y, x])

    x, y, d = x0, y0, 0
    ring = []
    while True:
        lx, ly, rx, ry = ahead[d]
        left, right = filled(x + lx, y + ly), filled(x + rx, y + ry)
        if left:  # the region lies to the right of the walk: turn towards what is filled on the left
            ring.append((float(x - 1), float(y - 1)))
            d = (d - 1) % 4
        elif right:
            x, y = x + steps[d][0], y + steps[d][1]
            if (x, y) == (x0, y0):
                return ring + [(float(x - 1), float(y - 1))] if (ring and ring[0] != (float(x - 1), float(y - 1))) else ring
        else:
            ring.append((float(x - 1), float(y - 1)))
            d = (d + 1) % 4


def _simple(ring: K.Ring, tolerance: float) -> K.Ring:
    """Simplified as far as the ring stays simple."""
    far = max(range(len(ring)), key=lambda i: (ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2)
    for k in range(5):
        t = tolerance / 2**k
        out = K.simplify(ring[:far + 1], t)[:-1] + K.simplify(ring[far:] + ring[:1], t)[:-1]
        if len(out) >= 3 and K.is_simple(out):
            return out
    return ring


def trace(lines: list[np.ndarray], widths: list[float], cm_per_pt: float, pixel_mm: float = 0.5, gap_mm: float = 0.0, least_cm2: float = 4.0) -> list[dict]:
    """Outlines in points, each with the cells between its lines: ``ring, area, cells`` (``id, ring, area``) and ``borders`` (``a, b, shared``)."""
    lines = [np.asarray(x, float) for x in lines if len(x) > 1]
    if not lines:
        return []
    scale = cm_per_pt * 10 / pixel_mm  # pixels per point
    radius = gap_mm / pixel_mm / 2
    margin = int(radius + max(widths) * scale) + 4
    low = np.min([x.min(0) for x in lines], axis=0)
    size = np.max([x.max(0) for x in lines], axis=0) - low
    width, height = (int(np.ceil(v * scale)) + 2 * margin + 1 for v in size)
    if width * height > MAX_PIXELS:
        raise K.GeometryError("trace.tooLarge")
    drawn = paint((height, width), [(x - low) * scale + margin for x in lines], [w * scale for w in widths])
    barrier = disk(drawn, radius)
    free, n = labels(~barrier)
    outside = free == free[0, 0]
    inside = disk(~outside, radius, grow=False) | drawn if radius > 0 else ~outside
    parts, n = labels(inside, diagonal=True)
    count = np.bincount(parts.ravel(), minlength=n + 1)
    cm2 = (pixel_mm / 10) ** 2
    out = []
    for k in range(1, n + 1):
        if count[k] * cm2 < least_cm2:
            continue
        own = parts == k
        if not (own & ~barrier & ~outside).any():  # a line that encloses nothing
            continue
        ys, xs = np.nonzero(own)
        box = slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1)
        part = own[box]

        def ring_of(m: np.ndarray) -> K.Ring:
            ring = _simple(border(m), SIMPLIFY_MM / pixel_mm)
            return [((x + box[1].start - margin - 0.5) / scale + low[0], (y + box[0].start - margin - 0.5) / scale + low[1]) for x, y in ring]

        cells = _cells(part, barrier[box])
        notches = notch_cells(cells, NOTCH_CM2 / cm2)
        if len(notches):
            part = part & ~np.isin(cells, notches)
            cells = np.where(part, cells, 0)
            if part.sum() * cm2 < least_cm2:
                continue
        ids, borders = _merged(cells, SMALL_CELL_CM2 / cm2)
        _, _, rim = border_table(cells)
        found = [{"id": i, "ring": ring_of(cells == i), "area": float((cells == i).sum()) / scale**2, "outside": bool(rim[i])} for i in ids]
        out.append({"ring": ring_of(part), "area": float(part.sum()) / scale**2, "cells": found, "borders": [(a, b, s / scale) for (a, b), s in sorted(borders.items())]})
    return out


def _cells(part: np.ndarray, barrier: np.ndarray) -> np.ndarray:
    """Numbered regions between the lines, grown over the lines until they meet."""
    cells, _ = labels(part & ~barrier)
    while True:
        empty = part & (cells == 0)
        if not empty.any():
            return cells
        grown = cells.copy()
        for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0)):
            near = np.roll(cells, (dy, dx), (0, 1))
            if dy:
                near[0 if dy > 0 else -1] = 0
            else:
                near[:, 0 if dx > 0 else -1] = 0
            take = empty & (grown == 0) & (near > 0)
            grown[take] = near[take]
        if (grown == cells).all():  # parts that hold no cell of their own
            grown[empty] = cells.max()
            return grown
        cells = grown


def border_table(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By cell number: pixels, border towards other cells, border towards the outside (0), in pixel edges."""
    framed = np.pad(cells, 1)
    size = np.bincount(framed.ravel())
    inner, rim = np.zeros(len(size), int), np.zeros(len(size), int)
    for a, b in ((framed[:, :-1], framed[:, 1:]), (framed[:-1], framed[1:])):
        for x, y in ((a, b), (b, a)):
            inner += np.bincount(x[(x != y) & (y > 0)], minlength=len(size))
            rim += np.bincount(x[(x > 0) & (y == 0)], minlength=len(size))
    return size, inner, rim


def notch_cells(cells: np.ndarray, least: float) -> np.ndarray:
    """Small cells at the rim that border the outside more than other cells: marks beside the line; none if all cells are such."""
    size, inner, rim = border_table(cells)
    own = np.arange(len(size)) > 0
    marks = own & (size > 0) & (size < least) & (rim > 0) & (inner < rim)
    return np.flatnonzero(marks) if (own & (size > 0) & ~marks).any() else np.empty(0, int)


def _merged(cells: np.ndarray, least: float) -> tuple[list[int], dict[tuple[int, int], int]]:
    """Cells below the area join the neighbour with the longest border, smallest first; changes ``cells``."""
    while True:
        borders: dict[tuple[int, int], int] = {}
        for a, b in ((cells[:, :-1], cells[:, 1:]), (cells[:-1], cells[1:])):
            differ = (a != b) & (a > 0) & (b > 0)
            pair, times = np.unique(np.stack([np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])]), axis=1, return_counts=True)
            for (x, y), t in zip(pair.T.tolist(), times.tolist()):
                borders[x, y] = borders.get((x, y), 0) + t
        ids, area = np.unique(cells[cells > 0], return_counts=True)
        small = sorted((int(a), int(i)) for a, i in zip(area, ids) if a < least and any(i in k for k in borders))
        if not small or len(ids) == 1:
            return ids.tolist(), borders
        i = small[0][1]
        _, other = max((s, -(a + b - i)) for (a, b), s in borders.items() if i in (a, b))
        cells[cells == i] = -other  # the pair was kept negative, for ties to go to the smaller id


SHAPES = T.StructType([
    T.StructField("doc", T.StringType()), T.StructField("size", T.StringType()), T.StructField("outline_id", T.IntegerType()), T.StructField("ring", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("area", T.DoubleType()), T.StructField("cells", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("ring", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("area", T.DoubleType()), T.StructField("outside", T.BooleanType())]))),
    T.StructField("borders", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("shared", T.DoubleType())])))])


def trace_sizes(lines: DataFrame, cm_per_pt: float, pixel_mm: float = 0.5, gap_mm: float = 0.0, least_cm2: float = 4.0) -> DataFrame:
    """Outlines of every sheet and size from ``doc, size, points, width``: a row for each, largest first."""
    def run(rows: list[dict]) -> list[tuple]:
        drawn = sorted((tuple(map(tuple, r["points"])), r["width"]) for r in rows)
        doc, size = rows[0]["doc"], rows[0]["size"]
        few = sum(len(points) for points, _ in drawn) <= REMEMBERED_POINTS
        shapes = (_traced if few else _traced.__wrapped__)(tuple(drawn), cm_per_pt, pixel_mm, gap_mm, least_cm2)
        return [(doc, size, k, *s) for k, s in enumerate(shapes)]

    return by_group(lines.select("doc", "size", "points", "width"), ["doc", "size"], run, SHAPES)


#: Sheets of more points are traced each time, as what is remembered has to stay small.
REMEMBERED_POINTS = 1000


@lru_cache(maxsize=1024)
def _traced(drawn: tuple, cm_per_pt: float, pixel_mm: float, gap_mm: float, least_cm2: float) -> list[tuple]:
    """Outlines of one sheet and size as the last columns of ``SHAPES``, largest first; equal sheets share them."""
    shapes = trace([np.array(points) for points, _ in drawn], [w for _, w in drawn], cm_per_pt, pixel_mm, gap_mm, least_cm2)
    shapes.sort(key=lambda s: -s["area"])
    return [(s["ring"], s["area"], s["cells"], [{"a": a, "b": b, "shared": n} for a, b, n in s["borders"]]) for s in shapes]


#: The coarse trace that tells styles apart: pixels and gaps of 1 mm, areas from 15 cm2, twice the area of the next style.
PROBE_MM, PROBE_CM2, PROBE_LEAD = 1.0, 15.0, 2.0


def suggest_assignments(subpaths: DataFrame, scales: DataFrame) -> DataFrame:
    """``doc, style, size``: the one style of a sheet that encloses over twice the area of any other, as the size ``uni``.

    ``subpaths(doc, points, closed, style, width)`` without furniture and scale
    marks, ``scales(doc, cm_per_pt)``.  Sheets where none does, or nothing is
    enclosed, have no row.
    """
    k = F.col("cm_per_pt")
    shut = F.when(F.col("closed") | F.col("style").startswith("fill"), F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    lines = subpaths.where(F.size("points") > 1).join(scales, "doc").select(
        F.col("doc").cast("string").alias("doc"), F.col("style").alias("size"), F.transform(shut, lambda p: F.array(p[0] * k, p[1] * k)).alias("points"), (F.coalesce("width", F.lit(1.0)) * k).alias("width"))
    areas = trace_sizes(lines, 1.0, PROBE_MM, PROBE_MM, PROBE_CM2).groupBy("doc", "size").agg(F.sum("area").alias("area"))
    best = Window.partitionBy("doc").orderBy(F.desc("area"), "size")
    ranked = areas.withColumn("next", F.coalesce(F.lead("area").over(best), F.lit(0.0))).withColumn("r", F.row_number().over(best))
    return ranked.where((F.col("r") == 1) & (F.col("area") > PROBE_LEAD * F.col("next"))).select("doc", F.col("size").alias("style"), F.lit("uni").alias("size"))
