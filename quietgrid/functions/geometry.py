"""Boxes and poses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int) -> Column:
    """struct(x1, y1, x2, y2) in pixels: width and height instead of a second corner, or shares of the frame, are turned into corners; clamped, at least one pixel wide and high."""
    as_size = (x2 <= x1) | (y2 <= y1)
    x2, y2 = F.when(as_size, x1 + x2).otherwise(x2), F.when(as_size, y1 + y2).otherwise(y2)
    share = F.greatest(x1, y1, x2, y2) <= 1.5
    px = [F.bround(F.when(share, v * n).otherwise(v), 0).cast("int") for v, n in ((x1, width), (y1, height), (x2, width), (y2, height))]
    a, b = (F.greatest(F.lit(0), F.least(v, F.lit(n - 1))) for v, n in ((px[0], width), (px[1], height)))
    c, d = (F.greatest(F.lit(0), F.least(v, F.lit(n))) for v, n in ((px[2], width), (px[3], height)))
    c, d = F.when(c <= a, F.least(F.lit(width), a + 1)).otherwise(c), F.when(d <= b, F.least(F.lit(height), b + 1)).otherwise(d)
    return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))


def box_area(box: Column) -> Column:
    return F.greatest(F.lit(0), box["x2"] - box["x1"]) * F.greatest(F.lit(0), box["y2"] - box["y1"])


def looks_fallen(joints: Column, least: float = 0.2) -> Column:
    """Whether a pose (array of array[x, y, confidence], five joints or more) is wider than 1.3 times its height."""
    sure = F.filter(joints, lambda j: j[2] > least)
    seen = F.when(F.size(sure) > 0, sure).otherwise(joints)
    span = lambda k: F.array_max(F.transform(seen, lambda j: j[k])) - F.array_min(F.transform(seen, lambda j: j[k]))
    return F.when(F.size(joints) >= 5, span(0) > span(1) * 1.3).otherwise(False)
