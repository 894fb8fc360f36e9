"""Boxes and tiles: driver-side values, and the Columns that test rows against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mercator import Plane

LOW, HIGH = -(1 << 31), (1 << 31) - 1


@dataclass(frozen=True)
class Box:
    """Inclusive integer bounds. min_x > max_x crosses the antimeridian; min_y > max_y is empty."""

    min_x: int
    min_y: int
    max_x: int
    max_y: int

    @staticmethod
    def of_wsen(west: float, south: float, east: float, north: float) -> Box:
        return Box(Plane.x(west), Plane.y(south), Plane.x(east), Plane.y(north))

    @staticmethod
    def world() -> Box:
        return Box(LOW, LOW, HIGH, HIGH)

    @staticmethod
    def empty() -> Box:
        return Box(HIGH, HIGH, LOW, LOW)

    @staticmethod
    def around(x: int, y: int, units: int) -> Box:
        return Box(x, y, x, y).buffered(units)

    @staticmethod
    def around_meters(x: int, y: int, meters: float) -> Box:
        return Box.around(x, y, int(Plane.units(meters, y) + 0.5))

    @property
    def is_empty(self) -> bool:
        return self.min_y > self.max_y

    @property
    def wraps(self) -> bool:
        return self.min_x > self.max_x and not self.is_empty

    def buffered(self, units: int) -> Box:
        if self.is_empty:
            return self
        wide = (self.max_x - self.min_x) % (1 << 32) + 2 * units >= (1 << 32) - 1
        xs = (LOW, HIGH) if wide else (wrap(self.min_x - units), wrap(self.max_x + units))
        return Box(xs[0], max(LOW, self.min_y - units), xs[1], min(HIGH, self.max_y + units))

    def expanded(self, x: int, y: int) -> Box:
        if self.is_empty:
            return Box(x, y, x, y)
        return Box(min(self.min_x, x), min(self.min_y, y), max(self.max_x, x), max(self.max_y, y))

    def united(self, other: Box) -> Box:
        if self.is_empty or other.is_empty:
            return other if self.is_empty else self
        return Box(min(self.min_x, other.min_x), min(self.min_y, other.min_y), max(self.max_x, other.max_x), max(self.max_y, other.max_y))

    def contains(self, x: int, y: int) -> bool:
        across = x >= self.min_x or x <= self.max_x if self.wraps else self.min_x <= x <= self.max_x
        return across and self.min_y <= y <= self.max_y

    def ranges(self) -> list[tuple[int, int]]:
        """The box's one or two ranges of x."""
        if self.is_empty:
            return []
        return [(self.min_x, HIGH), (LOW, self.max_x)] if self.wraps else [(self.min_x, self.max_x)]

    def intersects(self, other: Box) -> bool:
        return (
            self.min_y <= other.max_y
            and other.min_y <= self.max_y
            and any(a <= d and c <= b for a, b in self.ranges() for c, d in other.ranges())
        )

    def intersection(self, other: Box) -> Box:
        """Of boxes that don't cross the antimeridian."""
        found = Box(max(self.min_x, other.min_x), max(self.min_y, other.min_y), min(self.max_x, other.max_x), min(self.max_y, other.max_y))
        return Box.empty() if found.min_x > found.max_x or found.is_empty else found

    def center(self) -> tuple[int, int]:
        return int((self.min_x + self.max_x) / 2), int((self.min_y + self.max_y) / 2)

    def touches(self) -> Column:
        """Rows whose bounds meet the box: plain comparisons of columns, which reach the Parquet scan."""
        if self.is_empty:
            return F.lit(False)
        if self.wraps:
            across = (F.col("max_x") >= self.min_x) | (F.col("min_x") <= self.max_x)
        else:
            across = (F.col("max_x") >= self.min_x) & (F.col("min_x") <= self.max_x)
        return across & (F.col("max_y") >= self.min_y) & (F.col("min_y") <= self.max_y)


def wrap(x: int) -> int:
    return (x - LOW) % (1 << 32) + LOW


@dataclass(frozen=True)
class Tile:
    """A square of the map at a zoom of 0 to 12; column from the west, row from the north."""

    zoom: int
    column: int
    row: int

    @staticmethod
    def at(x: int, y: int, zoom: int) -> Tile:
        return Tile(zoom, (x - LOW) >> (32 - zoom) if zoom else 0, (HIGH - y) >> (32 - zoom) if zoom else 0)

    @property
    def bounds(self) -> Box:
        size = 1 << (32 - self.zoom)
        left, top = LOW + self.column * size, HIGH - self.row * size
        return Box(left, top - size + 1, left + size - 1, top)

    def zoomed_out(self, zoom: int) -> Tile:
        return Tile(zoom, self.column >> (self.zoom - zoom), self.row >> (self.zoom - zoom))

    def neighbor(self, right: int, down: int) -> Tile:
        n = 1 << self.zoom
        return Tile(self.zoom, (self.column + right) % n, (self.row + down) % n)

    @property
    def number(self) -> int:
        return self.zoom << 24 | self.row << 12 | self.column

    def __str__(self) -> str:
        return f"{self.zoom}/{self.column}/{self.row}"


def column_from_x(x: Column, zoom: int) -> Column:
    return F.shiftright(x.cast("long") + 2147483648, 32 - zoom).cast("int") if zoom else F.lit(0)


def row_from_y(y: Column, zoom: int) -> Column:
    return F.shiftright(F.lit(2147483647) - y.cast("long"), 32 - zoom).cast("int") if zoom else F.lit(0)


def cell(x: Column, y: Column, zoom: int = 12) -> Column:
    """The number of the tile that holds a point."""
    return (F.lit(zoom << 24) + row_from_y(y, zoom) * 4096 + column_from_x(x, zoom)).cast("int")


def hilbert(column: Column, row: Column, zoom: int = 12) -> Column:
    """Place of a tile on the Hilbert curve through all tiles of a zoom: tiles near on the curve are near on the map."""

    def step(state: Column, bit: Column) -> Column:
        side = F.shiftleft(F.lit(1), zoom) - 1
        x, y, d = state["x"], state["y"], state["d"]
        right, down = x.bitwiseAND(bit) > 0, y.bitwiseAND(bit) > 0
        quarter = F.when(right, F.when(down, 2).otherwise(3)).otherwise(F.when(down, 1).otherwise(0)).cast("long")
        turned_x = F.when(down, x).when(right, side - y).otherwise(y)
        turned_y = F.when(down, y).when(right, side - x).otherwise(x)
        return F.struct(turned_x.cast("int").alias("x"), turned_y.cast("int").alias("y"), (d + quarter * bit * bit).alias("d"))

    bits = F.array(*[F.lit(1 << k).cast("int") for k in range(zoom - 1, -1, -1)])
    start = F.struct(column.cast("int").alias("x"), row.cast("int").alias("y"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(bits, start, step, lambda s: s["d"])


def tile_pair(tiles: list[Tile]) -> tuple[Tile, ...]:
    """The smallest cover of tiles by one tile, or by two of one zoom side by side."""
    if not tiles:
        return ()
    for zoom in range(min(t.zoom for t in tiles), -1, -1):
        found = sorted({t.zoomed_out(zoom) for t in tiles}, key=lambda t: (t.row, t.column))
        if len(found) == 1 or len(found) == 2 and found[1] in (found[0].neighbor(1, 0), found[0].neighbor(0, 1), found[0].neighbor(-1, 0)):
            return tuple(found)
    raise AssertionError("one tile of zoom 0 covers all")
