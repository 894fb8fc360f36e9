"""Integer Mercator coordinates: conversions as Columns, and the same on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width of the projected plane in units, and the equator in meters.
MAP_WIDTH = 4294967294.9999
EARTH_CIRCUMFERENCE = 40075016.68558


def x_from_lon(lon: Column) -> Column:
    return F.round(lon * (MAP_WIDTH / 360.0)).cast("int")


def y_from_lat(lat: Column) -> Column:
    return F.round(F.ln(F.tan((lat + 90.0) * (math.pi / 360.0))) * (MAP_WIDTH / 2 / math.pi)).cast("int")


def lon_from_x(x: Column) -> Column:
    return x * 360.0 / MAP_WIDTH


def lat_from_y(y: Column) -> Column:
    return F.atan(F.exp(y * (2 * math.pi / MAP_WIDTH))) * 360.0 / math.pi - 90.0


def rounded(degrees: Column) -> Column:
    """To a ten-millionth of a degree."""
    return F.round(degrees, 7)


def fixed(degrees: Column) -> Column:
    """Ten-millionths of a degree, as an integer."""
    return F.round(degrees * 1e7).cast("int")


def from_fixed(value: Column) -> Column:
    return value / 1e7


def scale(y: Column) -> Column:
    return F.cosh(y * (2 * math.pi / MAP_WIDTH))


def meters_per_unit(y: Column) -> Column:
    return F.lit(EARTH_CIRCUMFERENCE / MAP_WIDTH) / scale(y)


def units_from_meters(meters: Column, y: Column) -> Column:
    return meters * (MAP_WIDTH / EARTH_CIRCUMFERENCE) * scale(y)


def meters_between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1.cast("double") - x2, y1.cast("double") - y2
    return F.sqrt(dx * dx + dy * dy) * meters_per_unit((y1.cast("double") + y2) / 2)


class Plane:
    """The same conversions of single numbers."""

    @staticmethod
    def x(lon: float) -> int:
        return math.floor(MAP_WIDTH * lon / 360.0 + 0.5)

    @staticmethod
    def y(lat: float) -> int:
        return math.floor(math.log(math.tan((lat + 90.0) * math.pi / 360.0)) * (MAP_WIDTH / 2 / math.pi) + 0.5)

    @staticmethod
    def lon(x: float) -> float:
        return x * 360.0 / MAP_WIDTH

    @staticmethod
    def lat(y: float) -> float:
        return math.degrees(2 * math.atan(math.exp(y * 2 * math.pi / MAP_WIDTH))) - 90.0

    @staticmethod
    def units(meters: float, y: float) -> float:
        return meters * MAP_WIDTH / EARTH_CIRCUMFERENCE * math.cosh(y * 2 * math.pi / MAP_WIDTH)
