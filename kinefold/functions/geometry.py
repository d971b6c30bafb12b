"""Plane geometry on columns: distances, grids, boxes, homographies, areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pitch half sizes in metres, origin at the centre spot.
HALF_LENGTH, HALF_WIDTH = 52.5, 34.0


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean distance."""
    dx, dy = x1 - x0, y1 - y0
    return F.sqrt(dx * dx + dy * dy)


def finite_pair(xy: Column) -> Column:
    """Exactly two finite numbers."""
    a, b = F.get(xy, F.lit(0)), F.get(xy, F.lit(1))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return xy.isNotNull() & (F.size(xy) == 2) & fine(a) & fine(b)


def cell(v: Column, low: float, span: float, n: int) -> Column:
    """Grid cell of a coordinate, the upper border in the last cell; null outside."""
    return F.when((v >= low) & (v <= low + span), F.least(F.floor((v - low) * n / span), F.lit(n - 1)).cast("int"))


def on_pitch(x: Column, y: Column, margin: float = 0.0) -> Column:
    """Within the lines, or at most ``margin`` metres outside."""
    return (F.abs(x) <= HALF_LENGTH + margin) & (F.abs(y) <= HALF_WIDTH + margin)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x, y, width, height); 0 for empty boxes."""
    g = lambda c, i: F.get(c, F.lit(i))
    w = F.greatest(F.lit(0.0), F.least(g(a, 0) + g(a, 2), g(b, 0) + g(b, 2)) - F.greatest(g(a, 0), g(b, 0)))
    h = F.greatest(F.lit(0.0), F.least(g(a, 1) + g(a, 3), g(b, 1) + g(b, 3)) - F.greatest(g(a, 1), g(b, 1)))
    both = g(a, 2) * g(a, 3) + g(b, 2) * g(b, 3) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def box_edges(box: Column, prefix: str) -> list[Column]:
    """``prefix_x0, _y0, _x1, _y1, _area`` of a box (x, y, width, height)."""
    g = lambda i: F.get(box, F.lit(i))
    parts = {"x0": g(0), "y0": g(1), "x1": g(0) + g(2), "y1": g(1) + g(3), "area": g(2) * g(3)}
    return [c.alias(f"{prefix}_{name}") for name, c in parts.items()]


def edges_overlap(a: str, b: str) -> tuple[Column, Column]:
    """Area that two boxes share and their intersection over union, from the columns of ``box_edges``; no union, no value."""
    w = F.greatest(F.lit(0.0), F.least(f"{a}_x1", f"{b}_x1") - F.greatest(f"{a}_x0", f"{b}_x0"))
    h = F.greatest(F.lit(0.0), F.least(f"{a}_y1", f"{b}_y1") - F.greatest(f"{a}_y0", f"{b}_y0"))
    return w * h, F.try_divide(w * h, F.col(f"{a}_area") + F.col(f"{b}_area") - w * h)


def foot_point(box: Column) -> tuple[Column, Column]:
    """Middle of a box's lower edge."""
    g = lambda i: F.get(box, F.lit(i))
    return g(0) + g(2) / 2, g(1) + g(3)


def project(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a row-major 3 x 3 homography; null at infinity."""
    g = lambda i: F.get(h, F.lit(i))
    w = g(6) * x + g(7) * y + g(8)
    return F.try_divide(g(0) * x + g(1) * y + g(2), w), F.try_divide(g(3) * x + g(4) * y + g(5), w)


def determinant(h: Column) -> Column:
    """Determinant of a row-major 3 x 3 matrix."""
    g = lambda i: F.get(h, F.lit(i))
    return g(0) * (g(4) * g(8) - g(5) * g(7)) - g(1) * (g(3) * g(8) - g(5) * g(6)) + g(2) * (g(3) * g(7) - g(4) * g(6))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _turn(o: Column, a: Column, b: Column) -> Column:
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def _half_hull(points: Column) -> Column:
    """One side of the hull of points in order: drop the last while the next is no left turn."""
    def push(kept: Column, p: Column) -> Column:
        at = lambda c, back: F.element_at(c, F.size(c) - back)
        # at most as many removals as points kept; each step removes one if needed
        trimmed = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(kept))), kept,
                              lambda s, _: F.when((F.size(s) >= 2) & (_turn(at(s, 1), at(s, 0), p) <= 0), F.slice(s, 1, F.size(s) - 1)).otherwise(s))
        return F.concat(trimmed, F.array(p))
    return F.aggregate(points, F.slice(points, 1, 0), push)


def polygon_area(points: Column) -> Column:
    """Shoelace area of an array of structs x, y in order; 0 below three points."""
    def area(p: Column) -> Column:
        after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1))
        double = F.aggregate(F.zip_with(p, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(p) >= 3, F.abs(double) / 2).otherwise(0.0)
    return _let(points, area)


def hull_area(points: Column) -> Column:
    """Area of the convex hull of an array of structs x, y; 0 where it has none (all in the JVM)."""
    body = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    def area(order: Column) -> Column:
        hull = F.concat(_let(_half_hull(order), body), _let(_let(F.reverse(order), _half_hull), body))
        return F.when(F.size(order) >= 3, polygon_area(hull)).otherwise(0.0)
    return _let(F.array_sort(F.array_distinct(points)), area)
