"""Geometries in and out: well-known text and binary, in degrees, to test shapes and from feature geometries."""

from __future__ import annotations

import re
import struct

import numpy as np

from ..operators.kernel import Shape
from .mercator import Plane

# Kinds of well-known binary, in order from 1.
KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION")
TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


class GeometryError(ValueError):
    """Malformed text or binary."""


#: A geometry read: its kind, and nested lists of (lon, lat), for collections of geometries.
Geometry = tuple[str, list]


def parse_wkt(text: str) -> Geometry:
    """Of one geometry; numbers beyond the second of a place are dropped."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise GeometryError(f"unexpected character at {at}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()

    def take(*wanted: str) -> str:
        if not tokens or wanted and tokens[-1].upper() not in wanted:
            raise GeometryError(f"expected {' or '.join(wanted)}, found {tokens[-1] if tokens else 'the end'}")
        return tokens.pop()

    def place() -> tuple[float, float]:
        numbers = []
        while tokens and tokens[-1] not in (",", ")"):
            try:
                numbers.append(float(take()))
            except ValueError as e:
                raise GeometryError(str(e)) from None
        if len(numbers) < 2:
            raise GeometryError("a place has two numbers")
        return numbers[0], numbers[1]

    def listed(one) -> list:
        if tokens and tokens[-1].upper() == "EMPTY":
            tokens.pop()
            return []
        take("(")
        found = [one()]
        while take(",", ")") == ",":
            found.append(one())
        return found

    def bare() -> tuple[float, float]:
        """A place of a multipoint, in parentheses or not."""
        if tokens and tokens[-1] == "(":
            return listed(place)[0]
        return place()

    line = lambda: listed(place)
    rings = lambda: listed(line)

    def geometry() -> Geometry:
        kind = take(*KINDS).upper()
        if tokens and tokens[-1].upper() in ("Z", "M", "ZM"):
            tokens.pop()
        made = {"POINT": line, "LINESTRING": line, "POLYGON": rings, "MULTIPOINT": lambda: listed(bare), "MULTILINESTRING": rings,
                "MULTIPOLYGON": lambda: listed(rings), "GEOMETRYCOLLECTION": lambda: listed(geometry)}[kind]()
        return kind, made

    found = geometry()
    if tokens:
        raise GeometryError(f"unexpected {tokens[-1]}")
    return found


def to_wkb(geometry: Geometry) -> bytes:
    """Little-endian; an empty point has no numbers (NaN)."""
    kind, parts = geometry
    places = lambda ps: struct.pack("<I", len(ps)) + b"".join(struct.pack("<dd", *p) for p in ps)
    rings = lambda rs: struct.pack("<I", len(rs)) + b"".join(map(places, rs))
    many = lambda k: struct.pack("<I", len(parts)) + b"".join(to_wkb((k, p)) for p in parts)
    body = {
        "POINT": lambda: struct.pack("<dd", *(parts[0] if parts else (float("nan"),) * 2)), "LINESTRING": lambda: places(parts), "POLYGON": lambda: rings(parts),
        "MULTIPOINT": lambda: struct.pack("<I", len(parts)) + b"".join(to_wkb(("POINT", [p])) for p in parts), "MULTILINESTRING": lambda: many("LINESTRING"),
        "MULTIPOLYGON": lambda: many("POLYGON"), "GEOMETRYCOLLECTION": lambda: struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts)),
    }[kind]()
    return struct.pack("<BI", 1, 1 + KINDS.index(kind)) + body


def parse_wkb(data: bytes) -> Geometry:
    """Of one geometry, of either byte order, with or without further numbers a place (both of the known flag styles)."""
    at = 0

    def read(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize(form)
        if at + size > len(data):
            raise GeometryError(f"cut off at {at}")
        found = struct.unpack_from(form, data, at)
        at += size
        return found

    def geometry() -> Geometry:
        order = "<" if read("B")[0] == 1 else ">"
        number = read(order + "I")[0]
        more = bool(number & 0x80000000) + bool(number & 0x40000000) + (0, 1, 1, 2)[(number & 0xFFFF) // 1000 % 4]
        if number & 0x20000000:
            read(order + "I")  # a reference system: degrees are taken for granted
        code = (number & 0xFFFF) % 1000
        if not 1 <= code <= len(KINDS):
            raise GeometryError(f"unknown kind {code}")
        kind = KINDS[code - 1]
        place = lambda: read(order + "d" * (2 + more))[:2]
        places = lambda: [place() for _ in range(read(order + "I")[0])]
        if kind == "POINT":
            p = place()
            return kind, [] if p[0] != p[0] else [p]
        if kind == "LINESTRING":
            return kind, places()
        if kind == "POLYGON":
            return kind, [places() for _ in range(read(order + "I")[0])]
        inner = [geometry() for _ in range(read(order + "I")[0])]
        if kind == "GEOMETRYCOLLECTION":
            return kind, inner
        return kind, [p for _, ps in inner for p in ps] if kind == "MULTIPOINT" else [ps for _, ps in inner]

    found = geometry()
    if at < len(data):
        raise GeometryError(f"unexpected bytes at {at}")
    return found


def shape(geometry: str | bytes) -> Shape:
    """A test shape from well-known text or binary. Collections aren't test shapes."""
    kind, parts = parse_wkt(geometry) if isinstance(geometry, str) else parse_wkb(geometry)
    plane = lambda ps: np.asarray([(Plane.x(lon), Plane.y(lat)) for lon, lat in ps], "i8").reshape(-1, 2)
    if kind in ("POINT", "MULTIPOINT"):
        return Shape.of("point", [plane([p]) for p in parts])
    if kind in ("LINESTRING", "MULTILINESTRING"):
        return Shape.of("line", [plane(ps) for ps in ([parts] if kind == "LINESTRING" else parts)])
    if kind == "GEOMETRYCOLLECTION":
        raise GeometryError("a collection is no test shape")
    rings = parts if kind == "POLYGON" else [r for p in parts for r in p]
    return Shape.of("polygon", [plane(r if r[:1] == r[-1:] else [*r, r[0]]) for r in rings])
