"""Numbers behind a drawing: views of a sheet, ink, labels along rulers; as columns.

A view is ``struct<scale, x, y>``; sheets and boxes have a width and a height.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from selvage.functions import geometry as G

# The largest zoom is four times the fitting one, and twelve at least; a tap moves by six pixels at most.
ZOOM_TIMES, ZOOM_LEAST, TAP_PX = 4.0, 12.0, 6.0


def ink_color(rgb: Column, dark: Column | bool) -> Column:
    """``rgb(r,g,b)`` in whole steps; on a dark ground the lightness is turned over and the hue stays."""
    dark = dark if isinstance(dark, Column) else F.lit(dark)
    shift = F.when(dark, 1 - F.array_max(rgb) - F.array_min(rgb)).otherwise(0.0)
    parts = F.transform(rgb, lambda c: F.floor((c + shift) * 255 + 0.5).cast("long").cast("string"))
    return F.concat(F.lit("rgb("), F.array_join(parts, ","), F.lit(")"))


def size_color(index: Column) -> Column:
    """A hue for each index, a golden angle apart."""
    hue = F.pmod(index * 137.5 + 250, F.lit(360.0))
    whole = F.when(hue == F.floor(hue), hue.cast("long").cast("string")).otherwise(hue.cast("string"))
    return F.concat(F.lit("oklch(var(--size-l) var(--size-c) "), whole, F.lit(")"))


def scale_limits(sheet: Column, box: Column) -> Column:
    fit = F.least(box["width"] / sheet["width"], box["height"] / sheet["height"])
    return F.struct(fit.alias("least"), F.greatest(fit * ZOOM_TIMES, F.lit(ZOOM_LEAST)).alias("most"))


def _view(scale: Column, x: Column, y: Column) -> Column:
    return F.struct(scale.alias("scale"), x.alias("x"), y.alias("y"))


def fit_view(sheet: Column, box: Column) -> Column:
    """The whole sheet, centred."""
    s = scale_limits(sheet, box)["least"]
    return _view(s, (box["width"] - sheet["width"] * s) / 2, (box["height"] - sheet["height"] * s) / 2)


def clamp_view(view: Column, sheet: Column, box: Column) -> Column:
    """The zoom within its limits; an axis that fits is centred, a longer one covers the box."""
    limits = scale_limits(sheet, box)
    s = F.least(limits["most"], F.greatest(limits["least"], view["scale"]))

    def along(at: Column, content: Column, room: Column) -> Column:
        free = room - content
        return F.when(free >= 0, free / 2).otherwise(F.least(F.lit(0.0), F.greatest(free, at)))

    return _view(s, along(view["x"], sheet["width"] * s, box["width"]), along(view["y"], sheet["height"] * s, box["height"]))


def zoom_view(view: Column, factor: Column, at: Column, sheet: Column, box: Column) -> Column:
    """The point under ``at`` stays there, as far as the clamped view allows."""
    limits = scale_limits(sheet, box)
    s = F.least(limits["most"], F.greatest(limits["least"], view["scale"] * factor))
    k = s / view["scale"]
    return clamp_view(_view(s, at[0] - (at[0] - view["x"]) * k, at[1] - (at[1] - view["y"]) * k), sheet, box)


def screen_to_sheet(view: Column, left: Column, top: Column, at: Column) -> Column:
    return F.array((at[0] - view["x"]) / view["scale"] + left, (at[1] - view["y"]) / view["scale"] + top)


def is_tap(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy) <= TAP_PX


def inline_tokens(markup: Column, tokens: dict[str, str]) -> Column:
    """Style variables replaced by their values; unknown ones by nothing."""
    out = markup
    for name, value in tokens.items():
        out = F.replace(out, F.lit(f"var({name})"), F.lit(value))
    return F.regexp_replace(out, r"var\(--[\w-]+\)", "")


def label_point(ring: Column | str) -> Column:
    """Middle of the widest inner run at half the height; the box's middle where there is none."""
    b = G.bbox(ring)
    y = (b["min_y"] + b["max_y"]) / 2
    hit = F.filter(G.edges(ring), lambda e: (e["a"][1] <= y) != (e["b"][1] <= y))
    x = F.array_sort(F.transform(hit, lambda e: e["a"][0] + (y - e["a"][1]) * (e["b"][0] - e["a"][0]) / (e["b"][1] - e["a"][1])))
    runs = F.transform(F.filter(x, lambda _, i: i % 2 == 0), lambda lo, i: F.struct((F.get(x, 2 * i + 1) - lo).alias("width"), (-i).alias("first"), ((F.get(x, 2 * i + 1) + lo) / 2).alias("at")))
    best = F.array_max(F.filter(runs, lambda r: r["width"] > 0))
    return F.array(F.coalesce(best["at"], (b["min_x"] + b["max_x"]) / 2), y)


def breakpoints(values: Column | str, least_gap: float) -> Column:
    """``array<struct<v, label>>``: distinct tenths in order, labelled where the last label is far enough."""
    values = F.col(values) if isinstance(values, str) else values
    tenths = F.array_sort(F.array_distinct(F.transform(values, lambda v: G.js_round(v, 1))))
    start = F.struct(F.lit(float("-inf")).alias("last"), F.array().cast("array<struct<v:double,label:boolean>>").alias("out"))

    def step(s: Column, v: Column) -> Column:
        shown = v - s["last"] >= least_gap
        return F.struct(F.when(shown, v).otherwise(s["last"]).alias("last"), F.concat(s["out"], F.array(F.struct(v.alias("v"), shown.alias("label")))).alias("out"))

    return F.aggregate(tenths, start, step, lambda s: s["out"])
