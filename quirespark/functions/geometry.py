"""Column builders for boxes (struct x0, y0, x1, y1) and quadrilaterals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def from_pdf(left: Column, bottom: Column, right: Column, top: Column, width: Column, height: Column) -> Column:
    """A box in points, y upwards, as shares of the page, y downwards."""
    return box(left / width, 1 - top / height, right / width, 1 - bottom / height)


def orientation(a: Column, b: Column, c: Column, d: Column, tolerance: float = 1e-6) -> Column:
    """Flips that undo an image's matrix: subset of ['TB', 'LR']; null if it is turned or skewed."""
    flips = F.filter(F.array(F.when(d < 0, "TB"), F.when(a < 0, "LR")), lambda x: x.isNotNull())
    return F.when((F.abs(b) <= tolerance) & (F.abs(c) <= tolerance), flips)


def _corner(p: Column, q: Column, r: Column) -> Column:
    """Degrees by which the angle at q differs from a right one."""
    ux, uy, vx, vy = p["x"] - q["x"], p["y"] - q["y"], r["x"] - q["x"], r["y"] - q["y"]
    norm = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.abs(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm)))) - 90)


def corner_error(quad: Column) -> Column:
    """Largest deviation of a quad's (array of four struct x, y) corners from 90 degrees."""
    at = [F.element_at(quad, i + 1) for i in range(4)]
    return F.greatest(*[_corner(at[i - 1], at[i], at[(i + 1) % 4]) for i in range(4)])


def side_skew(quad: Column) -> Column:
    """Largest relative difference of opposite sides."""
    at = [F.element_at(quad, i + 1) for i in range(4)]
    side = [F.sqrt((at[i]["x"] - at[(i + 1) % 4]["x"]) ** 2 + (at[i]["y"] - at[(i + 1) % 4]["y"]) ** 2) for i in range(4)]
    ratio = lambda p, q: F.abs(p - q) / F.greatest(p, q)
    return F.greatest(ratio(side[0], side[2]), ratio(side[1], side[3]))


def unsafe_quad(quad: Column, max_error: float = 12.0, max_skew: float = 0.08) -> Column:
    return (corner_error(quad) > max_error) | (side_skew(quad) > max_skew)
