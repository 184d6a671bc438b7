"""Boxes and polygons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _box(b: str | tuple) -> tuple[Column, ...]:
    return tuple(F.col(f"{b}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: str) -> Column:
    x1, y1, x2, y2 = _box(b)
    return (x2 - x1) * (y2 - y1)


def intersection(a: str, b: str) -> Column:
    """Of the boxes in columns a.x1.. and b.x1.., by prefix; 0 where they are apart."""
    ax1, ay1, ax2, ay2 = _box(a)
    bx1, by1, bx2, by2 = _box(b)
    zero = F.lit(0.0)
    return F.greatest(F.least(ax2, bx2) - F.greatest(ax1, bx1), zero) * F.greatest(F.least(ay2, by2) - F.greatest(ay1, by1), zero)


def iou(a: str, b: str) -> Column:
    shared = intersection(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def centre_distance(a: str, b: str) -> Column:
    """Divided by the unit square's diagonal, at most 1."""
    ax1, ay1, ax2, ay2 = _box(a)
    bx1, by1, bx2, by2 = _box(b)
    return F.least(F.lit(1.0), F.sqrt(F.pow((ax1 + ax2 - bx1 - bx2) / 2, 2) + F.pow((ay1 + ay2 - by1 - by2) / 2, 2)) / F.sqrt(F.lit(2.0)))


def scale_penalty(a: str, b: str) -> Column:
    """1 less the ratio of the smaller area to the larger; 1 for a box without area."""
    p, q = area(a), area(b)
    return F.when((p > 0) & (q > 0), 1 - F.least(p, q) / F.greatest(p, q)).otherwise(1.0)


def association_cost(a: str, b: str) -> Column:
    return 0.6 * (1 - iou(a, b)) + 0.25 * centre_distance(a, b) + 0.15 * scale_penalty(a, b)


def in_polygon(x: Column, y: Column, vertices: Column) -> Column:
    """Ray casting with half-open edges; fewer than three vertices hold nothing."""
    n = F.size(vertices)
    edges = F.zip_with(vertices, F.concat(F.slice(vertices, n, 1), F.slice(vertices, 1, n - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crossed(inside: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        crosses = ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return inside != F.coalesce(crosses, F.lit(False))

    return (n >= 3) & F.aggregate(edges, F.lit(False), crossed)


def truncation(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The share of a box beyond the unit square."""
    full = (x2 - x1) * (y2 - y1)
    seen = F.greatest(F.least(x2, F.lit(1.0)) - F.greatest(x1, F.lit(0.0)), F.lit(0.0)) * F.greatest(F.least(y2, F.lit(1.0)) - F.greatest(y1, F.lit(0.0)), F.lit(0.0))
    return F.when(full > 0, 1 - seen / full).otherwise(0.0)
