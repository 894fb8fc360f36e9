"""Length and area units."""

from __future__ import annotations

from pyspark.sql import Column

# Units in a meter.
PER_METER = {"m": 1.0, "km": 0.001, "ft": 3.28084, "yd": 1.093613, "mi": 0.0006213711922373339}
NAMES = {"meters": "m", "kilometers": "km", "feet": "ft", "yards": "yd", "miles": "mi"}
# Area units that aren't a squared length, in a square meter.
PER_SQUARE_METER = {"hc": 1e-4, "ac": 0.0002471053814671653}
AREA_NAMES = {"hectares": "hc", "acres": "ac"}


def factor(unit: str) -> tuple[float, bool]:
    """(units in a meter or square meter, whether it is an area unit); an unknown unit is an error."""
    unit = NAMES.get(unit, unit)
    if unit in PER_METER:
        return PER_METER[unit], False
    area = AREA_NAMES.get(unit, unit)
    if area in PER_SQUARE_METER:
        return PER_SQUARE_METER[area], True
    base = unit[7:] if unit.startswith("square_") else unit[:-1] if unit.endswith("2") else ""
    base = NAMES.get(base, base)
    if base in PER_METER:
        return PER_METER[base] ** 2, True
    raise ValueError(f"unknown unit: {unit}")


def convert(meters: Column, unit: str) -> Column:
    """From meters or square meters."""
    return meters * factor(unit)[0]


def to_meters(value: float, unit: str) -> float:
    return value / factor(unit)[0]
