"""Length, area and centroid of vertex arrays, as Columns. Vertices are an array of structs with x and y, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import meters_between, meters_per_unit


def steps(points: Column, of) -> Column:
    """Array of of(point, next point)."""
    return F.transform(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: of(p, F.get(points, i + 1)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def length(points: Column) -> Column:
    """Meters; of a closed line its perimeter."""
    return total(steps(points, lambda p, q: meters_between(p["x"], p["y"], q["x"], q["y"])))


def shoelace(points: Column) -> Column:
    """Twice the signed area in square units, counted from the first vertex so that products stay small."""
    x0, y0 = F.get(points, F.lit(0))["x"].cast("double"), F.get(points, F.lit(0))["y"].cast("double")
    return total(steps(points, lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)))


def area(points: Column, min_y: Column, max_y: Column) -> Column:
    """Square meters of a ring, by the scale in the middle of its bounds."""
    m = meters_per_unit((min_y.cast("double") + max_y) / 2)
    return F.abs(shoelace(points)) / 2 * m * m


def line_centroid(points: Column) -> Column:
    """Struct of x and y: midpoints of the segments by their length; of a line without length, its first vertex."""
    def seg(p: Column, q: Column) -> Column:
        dx, dy = q["x"].cast("double") - p["x"], q["y"].cast("double") - p["y"]
        n = F.sqrt(dx * dx + dy * dy)
        return F.struct(n.alias("n"), (n * (p["x"].cast("double") + q["x"]) / 2).alias("x"), (n * (p["y"].cast("double") + q["y"]) / 2).alias("y"))

    parts = steps(points, seg)
    n = total(F.transform(parts, lambda s: s["n"]))
    one = lambda c: F.when(n > 0, total(F.transform(parts, lambda s: s[c])) / n).otherwise(F.get(points, F.lit(0))[c].cast("double"))
    return F.struct(one("x").alias("x"), one("y").alias("y"))


def ring_centroid(points: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Struct of x and y; the middle of the bounds where the ring has no area."""
    x0, y0 = F.get(points, F.lit(0))["x"].cast("double"), F.get(points, F.lit(0))["y"].cast("double")

    def moment(c: str, base: Column) -> Column:
        cross = lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)
        return total(steps(points, lambda p, q: (p[c] - base + q[c] - base) * cross(p, q)))

    a = shoelace(points)
    one = lambda c, base, low, high: F.when(a != 0, base + moment(c, base) / (3 * a)).otherwise((low.cast("double") + high) / 2)
    return F.struct(one("x", x0, min_x, max_x).alias("x"), one("y", y0, min_y, max_y).alias("y"))


def middle(low: Column, high: Column) -> Column:
    """Middle of bounds, cut toward zero as integers are."""
    return ((low.cast("long") + high.cast("long")) / 2).cast("long")
