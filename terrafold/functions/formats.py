"""Text forms of features: numbers, WKT, GeoJSON, rows and CSV, and a Leaflet map."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mercator import lat_from_y, lon_from_x
from .tags import short_id, stored_number


def decimal(v: Column, precision: int = 7) -> Column:
    """A double with at most so many places, without trailing zeros."""
    fixed = F.round(v, precision).cast(f"decimal(30,{precision})").cast("string")
    short = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def pair(x: Column, y: Column, precision: int = 7, separator: str = " ") -> Column:
    return F.concat(decimal(lon_from_x(x), precision), F.lit(separator), decimal(lat_from_y(y), precision))


def wkt_point(x: Column, y: Column, precision: int = 7) -> Column:
    return F.concat(F.lit("POINT("), pair(x, y, precision), F.lit(")"))


def wkt_ring(points: Column, precision: int = 7) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: pair(p["x"], p["y"], precision)), ","), F.lit(")"))


def wkt_way(points: Column, is_area: Column, precision: int = 7) -> Column:
    ring = wkt_ring(points, precision)
    return F.when(is_area, F.concat(F.lit("POLYGON("), ring, F.lit(")"))).otherwise(F.concat(F.lit("LINESTRING"), ring))


def json_point(x: Column, y: Column, precision: int = 7) -> Column:
    return F.concat(F.lit("["), pair(x, y, precision, ","), F.lit("]"))


def json_ring(points: Column, precision: int = 7) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(points, lambda p: json_point(p["x"], p["y"], precision)), ","), F.lit("]"))


def geojson_geometry(kind: Column | str, coordinates: Column) -> Column:
    name = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit('{"type":"'), name, F.lit('","coordinates":'), coordinates, F.lit("}"))


def geojson_way(points: Column, is_area: Column, precision: int = 7) -> Column:
    ring = json_ring(points, precision)
    return F.when(is_area, geojson_geometry("Polygon", F.concat(F.lit("["), ring, F.lit("]")))).otherwise(geojson_geometry("LineString", ring))


def polygons(rings: DataFrame, form: str, precision: int = 7) -> DataFrame:
    """(rel_id, geometry) of assembled rings (rel_id, polygon, ring, points), as "wkt" or "geojson"."""
    one = wkt_ring(F.col("points"), precision) if form == "wkt" else json_ring(F.col("points"), precision)
    left, right = ("(", ")") if form == "wkt" else ("[", "]")
    joined = lambda c: F.concat(F.lit(left), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda s: s["t"]), ","), F.lit(right)).alias(c)
    each = rings.select("rel_id", "polygon", F.col("ring").alias("n"), one.alias("t")).groupBy("rel_id", "polygon").agg(joined("t"))
    every = each.select("rel_id", F.col("polygon").alias("n"), "t").groupBy("rel_id").agg(joined("all"), F.first("t").alias("only"), F.count("*").alias("k"))
    if form == "wkt":
        text = F.when(F.col("k") > 1, F.concat(F.lit("MULTIPOLYGON"), F.col("all"))).otherwise(F.concat(F.lit("POLYGON"), F.col("only")))
    else:
        text = F.when(F.col("k") > 1, geojson_geometry("MultiPolygon", F.col("all"))).otherwise(geojson_geometry("Polygon", F.col("only")))
    return every.select("rel_id", text.alias("geometry"))


def escaped(v: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(v.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def json_value(v: Column) -> Column:
    """Numbers bare, all else quoted."""
    return F.when(stored_number(v), v).otherwise(escaped(v))


def json_tags(tags: Column) -> Column:
    """A JSON object of tags in key order."""
    parts = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(escaped(e["key"]), F.lit(":"), json_value(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def geojson_feature(geometry: Column, tags: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","id":"'), short_id(), F.lit('","geometry":'), geometry, F.lit(',"properties":'), json_tags(tags), F.lit("}"))


def write_geojsonl(lines: DataFrame, path: str) -> None:
    """One feature a line."""
    lines.select("geojson").write.text(path)


def geojson_collection(lines: DataFrame, generator: str = "terrafold") -> str:
    """One FeatureCollection, built on the driver: for results that a person looks at."""
    rows = ",".join(r["geojson"] for r in lines.select("geojson").toLocalIterator())
    return '{"type":"FeatureCollection","generator":' + json.dumps(generator) + ',"features":[' + rows + "]}"


def pretty(collection: str) -> str:
    return json.dumps(json.loads(collection), indent=2, ensure_ascii=False)


class KeySchema:
    """Columns of a row: "id", "lon", "lat", "geom", "tags", keys, and wildcards "addr:*" or "*:en" that go to tags."""

    SPECIAL = ("id", "lon", "lat", "geom", "tags")

    def __init__(self, text: str):
        parts = [p.strip() for p in text.split(",") if p.strip()]
        wild = lambda p: p.endswith("*") or p.startswith("*")
        self.columns = list(dict.fromkeys(p for p in parts if not wild(p)))
        self.prefixes = [p[:-1] for p in parts if p.endswith("*") and p != "*"]
        self.suffixes = [p[1:] for p in parts if p.startswith("*") and p != "*"]
        self.keys = [c for c in self.columns if c not in self.SPECIAL]
        self.all = "*" in parts or ("tags" in self.columns and not self.prefixes and not self.suffixes)
        if (self.prefixes or self.suffixes or "*" in parts) and "tags" not in self.columns:
            self.columns.append("tags")

    def rest(self, tags: Column) -> Column:
        """Tags that wildcards take: a JSON object, empty text if there are none."""
        def taken(k: Column) -> Column:
            tests = [k.startswith(p) for p in self.prefixes] + [k.endswith(s) for s in self.suffixes]
            match = F.lit(True) if self.all else reduce(Column.__or__, tests, F.lit(False))
            return match & ~k.isin(self.keys) if self.keys else match

        left = F.map_filter(tags, lambda k, _: taken(k))
        return F.when(F.size(left) > 0, json_tags(left)).otherwise("")

    def select(self, rows: DataFrame, precision: int = 7) -> DataFrame:
        """Of rows with cx, cy (centroid) and wkt where the columns need them. Absent tags are empty."""
        special = {
            "id": lambda: short_id(), "lon": lambda: decimal(lon_from_x(F.col("cx")), precision), "lat": lambda: decimal(lat_from_y(F.col("cy")), precision),
            "geom": lambda: F.col("wkt"), "tags": lambda: self.rest(F.col("tags")),
        }
        return rows.select(*[(special[c]() if c in special else F.coalesce(F.col("tags")[c], F.lit(""))).alias(c) for c in self.columns])


def csv_field(v: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end; quotes are doubled."""
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in rows.columns]).alias("value"))


PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title>
<link rel="stylesheet" href="{base}leaflet.css"><script src="{base}leaflet.js"></script>
<style>#map {{ height: 100vh; margin: 0 }}</style></head><body style="margin:0"><div id="map"></div><script>
var map = L.map("map"); L.tileLayer({tiles}, {{attribution: {attribution}}}).addTo(map);
var all = L.featureGroup().addTo(map);
{shapes}
map.fitBounds(all.getBounds());
</script></body></html>
"""


def leaflet(shapes: list[dict], title: str = "Map", base: str = "", tiles: str = "https://tile.example/{z}/{x}/{y}.png", attribution: str = "") -> str:
    """A page that draws shapes: dicts of kind ("marker", "polyline", "polygon", "rectangle"), latlngs, label and options."""
    call = {"marker": "circleMarker", "polyline": "polyline", "polygon": "polygon", "rectangle": "rectangle"}
    safe = lambda v: json.dumps(v, ensure_ascii=False).replace("</", "<\\/")
    lines = []
    for s in shapes:
        line = f"L.{call[s['kind']]}({safe(s['latlngs'])}, {safe(s.get('options', {}))})"
        if s.get("label"):
            line += f".bindTooltip({safe(s['label'])})"
        lines.append(line + ".addTo(all);")
    return PAGE.format(title=title.replace("<", "&lt;"), base=base, tiles=safe(tiles), attribution=safe(attribution), shapes="\n".join(lines))
