"""Axis-aligned rectangles as column expressions. A rectangle is the four columns p_x, p_y, p_w, p_h of a prefix p."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parts(prefix: str) -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "w", "h"))


def intersection(a: str, b: str) -> Column:
    ax, ay, aw, ah = parts(a)
    bx, by, bw, bh = parts(b)
    width = F.least(ax + aw, bx + bw) - F.greatest(ax, bx)
    height = F.least(ay + ah, by + bh) - F.greatest(ay, by)
    return F.when((width > 0) & (height > 0), width * height).otherwise(F.lit(0.0))


def area(p: str) -> Column:
    _, _, w, h = parts(p)
    return w * h


def iou(a: str, b: str) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def containment(a: str, b: str) -> Column:
    """The share of b that lies in a."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(F.lit(0.0))


def x_overlap(a: str, b: str) -> Column:
    """Shared width over the narrower width."""
    ax, _, aw, _ = parts(a)
    bx, _, bw, _ = parts(b)
    narrow = F.least(aw, bw)
    return F.when(narrow > 0, F.greatest(F.least(ax + aw, bx + bw) - F.greatest(ax, bx), F.lit(0.0)) / narrow).otherwise(F.lit(0.0))


def bounding(*points: Column) -> Column:
    """struct<x, y, w, h> around two or more {x, y}."""
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    left, top = F.least(*xs), F.least(*ys)
    return F.struct(left.alias("x"), top.alias("y"), (F.greatest(*xs) - left).alias("w"), (F.greatest(*ys) - top).alias("h"))


def to_page(raw: Column, rotation: Column, width: Column, height: Column, back: bool = False) -> Column:
    """A raw box (from the lower left of the page before it is turned) as a box of the page as it is shown, width by height, from the upper left; or back."""
    turned = rotation.isin(90, 270)
    across, up = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    quarter = lambda a, b, c, d: F.when(rotation == 0, a).when(rotation == 90, b).when(rotation == 180, c).otherwise(d)
    zero, one = F.lit(0.0), F.lit(1.0)
    m = {"a": quarter(one, zero, -one, zero), "b": quarter(zero, one, zero, -one), "c": quarter(zero, one, zero, -one), "d": quarter(-one, zero, one, zero)}
    if back:
        shift = quarter(zero, zero, across, across), quarter(up, zero, zero, up)
    else:
        shift = quarter(zero, zero, across, up), quarter(up, zero, zero, across)
    place = lambda x, y: F.struct((x * m["a"] + y * m["c"] + shift[0]).alias("x"), (x * m["b"] + y * m["d"] + shift[1]).alias("y"))
    # Quarter turns leave opposite corners opposite, so these two bound the box.
    return bounding(place(raw["x"], raw["y"]), place(raw["x"] + raw["w"], raw["y"] + raw["h"]))
