"""The collection API: lazy, immutable sets of features that narrow step by step and run at a terminal call."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, geometry, measures, tags
from ..functions.box import Box
from ..functions.mercator import Plane, meters_per_unit
from ..sources.library import Library
from . import related, rings, spatial
from .kernel import Shape, distance
from .tagquery import compile_query, query_kinds

#: Bits of a member's number that one step of joining texts takes off.
PIECE_BITS = 16


class ResultError(ValueError):
    """one() found no feature, or more than one."""


@dataclass(frozen=True)
class Features:
    """Rows of a library's features, maybe with context: seq and role of members, child of parents.

    Every call gives a new set; constraints add up. ``df`` is the DataFrame behind it.
    """

    lib: Library
    df: DataFrame
    view: str = "world"
    kinds: frozenset = spatial.ALL

    @staticmethod
    def open(spark: SparkSession, path: str) -> Features:
        return Features.of(Library.open(spark, path))

    @staticmethod
    def of(lib: Library) -> Features:
        return Features(lib, lib.features)

    def _with(self, df: DataFrame, view: str | None = None) -> Features:
        return replace(self, df=df, view=view or self.view)

    # selection

    def __call__(self, what) -> Features:
        """A tag query, a Box, a point (x, y), a Shape or another set of one feature."""
        if isinstance(what, str):
            found = self._with(self.df.where(compile_query(what, {k: n for n, k in enumerate(self.lib.indexed)})))
            return replace(found, kinds=self.kinds & query_kinds(what))
        if isinstance(what, Box):
            return self._with(self.df.where(what.touches()))
        if isinstance(what, tuple):
            return self._with(self.df.where(Box(what[0], what[1], what[0], what[1]).touches()))
        return self.intersecting(what)

    def _typed(self, kind: int, query: str | None) -> Features:
        found = replace(self._with(self.df.where(F.col("type") == kind)), kinds=self.kinds & {kind})
        return found(query) if query else found

    def nodes(self, query: str | None = None) -> Features:
        return self._typed(0, query)

    def ways(self, query: str | None = None) -> Features:
        """Areas included."""
        return self._typed(1, query)

    def relations(self, query: str | None = None) -> Features:
        return self._typed(2, query)

    def empty(self) -> Features:
        return self._with(self.df.where(F.lit(False)))

    def __and__(self, other: Features) -> Features:
        return self._with(self.df.join(other.df.select("typed_id"), "typed_id", "left_semi"))

    def filter(self, predicate: Column | Callable[[pd.DataFrame], pd.Series]) -> Features:
        """A Column, or a function from a batch of rows to a boolean series."""
        if isinstance(predicate, Column):
            return self._with(self.df.where(predicate))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf[np.asarray(predicate(pdf), bool)]

        return self._with(self.df.mapInPandas(run, self.df.schema))

    # space

    def shape(self) -> Shape:
        """The geometry of a set of one feature, on the driver."""
        row = self.one()
        if row.type == 0:
            return Shape.of("point", [np.asarray([[row.min_x, row.min_y]])])
        me = self.lib.features.where(F.col("typed_id") == row.typed_id)
        if row.type == 1:
            ways = me
        else:
            deep = related.closure(self.lib, me).where("m_type = 1").select(F.col("m_typed_id").alias("typed_id"))
            ways = self.lib.features.join(deep, "typed_id", "left_semi")
        lines = spatial.coords(self.lib, ways.select("id")).collect()
        parts = [np.asarray([(p["x"], p["y"]) for p in r.points]) for r in lines]
        return Shape.of("polygon" if row.is_area else "collection" if row.type == 2 else "line", parts)

    def _shape(self, of, allow_collection: bool = False) -> Shape:
        """Of a set of one feature, a Shape, or well-known text or binary in degrees."""
        shape = of.shape() if isinstance(of, Features) else geometry.shape(bytes(of) if not isinstance(of, str) else of) if isinstance(of, (str, bytes, bytearray)) else of
        if shape.kind == "collection":
            if not allow_collection:
                raise spatial.UnsupportedGeometry("not defined for a relation that is no area")
            shape = replace(shape, kind="line")
        return shape

    def intersecting(self, of) -> Features:
        return self._with(spatial.intersecting(self.lib, self.df, self._shape(of), self.kinds))

    def within(self, of, strict: bool = False) -> Features:
        return self._with(spatial.within(self.lib, self.df, self._shape(of), strict, self.kinds))

    def crossing(self, of) -> Features:
        return self._with(spatial.crossing(self.lib, self.df, self._shape(of, True), self.kinds))

    def containing(self, x, y: int | None = None) -> Features:
        """Features that hold a point, given as x and y, or a whole geometry: its vertices, and its edges between them."""
        if y is not None:
            return self._with(spatial.containing_point(self.lib, self.df, x, y, self.kinds))
        return self._with(spatial.containing(self.lib, self.df, self._shape(x), self.kinds))

    def meters_to(self, of) -> float:
        """Between the nearest points of a set of one feature and a geometry, by the scale in the middle between them."""
        one, two = self._shape(self, True), self._shape(of, True)
        middle = (min(one.bounds[1], two.bounds[1]) + max(one.bounds[3], two.bounds[3])) / 2
        return distance(one, two) / Plane.units(1.0, middle)

    def containing_lonlat(self, lon: float, lat: float) -> Features:
        return self.containing(Plane.x(lon), Plane.y(lat))

    def max_meters_from(self, meters: float, x: int, y: int) -> Features:
        return self._with(spatial.max_meters_from(self.lib, self.df, meters, x, y, self.kinds))

    def max_meters_from_lonlat(self, meters: float, lon: float, lat: float) -> Features:
        return self.max_meters_from(meters, Plane.x(lon), Plane.y(lat))

    def with_length(self, low: float = 0.0, high: float = float("inf")) -> Features:
        found = self.lengths().where(F.col("length").between(low, high)).select("typed_id")
        return self._with(self.df.join(found, "typed_id", "left_semi"))

    def with_area(self, low: float = 0.0, high: float = float("inf")) -> Features:
        found = self.areas().where(F.col("area").between(low, high)).select("typed_id")
        return self._with(self.df.join(found, "typed_id", "left_semi"))

    # relationships: of all features of the set, in one join

    def _related(self, df: DataFrame, view: str) -> Features:
        return replace(self, df=df, view=view, kinds=spatial.ALL)

    def way_nodes(self, query: str | None = None) -> Features:
        """Vertices of the set's ways in order; with a query only those that are features and match."""
        found = self._related(related.way_nodes(self.lib, self.df, only_features=query is not None), "vertices")
        return found(query) if query else found

    def members(self, query: str | None = None) -> Features:
        found = self._related(related.members(self.lib, self.df), "members")
        return found(query) if query else found

    def parents(self, query: str | None = None) -> Features:
        found = self._related(related.parents(self.lib, self.df), "parents")
        return found(query) if query else found

    def nodes_of(self, of: Features) -> Features:
        return self & replace(of, df=related.way_nodes(self.lib, of.df, only_features=True))

    def members_of(self, of: Features) -> Features:
        both = related.members(self.lib, of.df).select("typed_id").union(related.way_nodes(self.lib, of.df, only_features=True).select("typed_id"))
        return self._with(self.df.join(both, "typed_id", "left_semi"))

    def parents_of(self, of: Features) -> Features:
        return self._with(self.df.join(related.parents(self.lib, of.df).select("typed_id"), "typed_id", "left_semi"))

    def connected_to(self, of: Features) -> Features:
        return self._with(related.connected(self.lib, self.df, of.df))

    def with_role(self, *roles: str) -> Features:
        """Members with one of the roles; other views have none."""
        return self._with(self.df.where(F.col("role").isin(*roles))) if self.view == "members" else self.empty()

    # nodes by what shares their place and what uses them

    def sharing_location(self) -> Features:
        """Nodes at whose place another node of the library lies. A place is counted with partial aggregates."""
        nodes = self.lib.features.where("type = 0").groupBy("min_x", "min_y").count().where("count > 1")
        return self.nodes()._with(self.df.where("type = 0").join(nodes, ["min_x", "min_y"], "left_semi").select(*self.df.columns))

    def duplicates(self) -> Features:
        """Nodes without tags that share their place."""
        return self.sharing_location().filter(F.coalesce(F.size("tags"), F.lit(0)) <= 0)

    def orphans(self) -> Features:
        """Nodes without tags that are no vertices and no members."""
        return self.nodes().filter((F.coalesce(F.size("tags"), F.lit(0)) <= 0) & ~F.col("is_waynode") & ~F.col("is_member"))

    # terminals

    def count(self) -> int:
        return self.df.count()

    def __contains__(self, feature) -> bool:
        """Whether a feature, a row with typed_id or a set of one, is in the set."""
        row = feature.one() if isinstance(feature, Features) else feature
        return row.typed_id is not None and not self.df.where(F.col("typed_id") == row.typed_id).isEmpty()

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode=mode)

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def __bool__(self) -> bool:
        return not self.is_empty()

    def _ordered(self) -> DataFrame:
        return self.df.orderBy("seq") if "seq" in self.df.columns else self.df

    def first(self) -> Row | None:
        """Some feature; of members and vertices the first in order."""
        return next(iter(self._ordered().limit(1).collect()), None)

    def one(self) -> Row:
        found = self.df.limit(2).collect()
        if len(found) != 1:
            raise ResultError("no feature found" if not found else "more than one feature found")
        return found[0]

    def to_list(self) -> list[Row]:
        return self._ordered().collect()

    def __iter__(self) -> Iterator[Row]:
        return self._ordered().toLocalIterator()

    def length(self) -> float:
        return self.lengths().agg(F.sum("length")).first()[0] or 0.0

    def area(self) -> float:
        return self.areas().agg(F.sum("area")).first()[0] or 0.0

    # measures of each feature

    def lengths(self) -> DataFrame:
        """(typed_id, length) in meters: of ways, and of relations by all their member ways; nodes have none."""
        own = spatial.pointed(self.lib, self.df.where("type = 1").dropDuplicates(["typed_id"]) if self.view != "world" else self.df.where("type = 1"))
        ways = own.select("typed_id", measures.length(F.col("points")).alias("length"))
        if 2 not in self.kinds:
            return ways
        parts = related.closure(self.lib, self.df).where("m_type = 1").select((F.col("root") * 4 + 2).alias("typed_id"), F.col("m_id").alias("id"))
        each = spatial.coords(self.lib, parts.select("id")).select("id", measures.length(F.col("points")).alias("length"))
        return ways.unionByName(parts.join(each, "id").groupBy("typed_id").agg(F.sum("length").alias("length")))

    def polygon_rings(self) -> DataFrame:
        return rings.polygonize(self.df.where("type = 2 AND is_area").select("id").distinct(), self.lib.members, self.lib.way_nodes)

    def areas(self) -> DataFrame:
        """(typed_id, area) in square meters of areas: of relations outer rings less holes."""
        w = self.df.where("type = 1 AND is_area")
        w = spatial.pointed(self.lib, w.dropDuplicates(["typed_id"]) if self.view != "world" else w)
        ways = w.select("typed_id", measures.area(F.col("points"), F.col("min_y"), F.col("max_y")).alias("area"))
        if 2 not in self.kinds:
            return ways
        r = self.df.where("type = 2").select("typed_id", "id", "min_y", "max_y").distinct()
        twice = F.abs(measures.shoelace(F.col("points"))) * F.when(F.col("ring") == 0, 1).otherwise(-1)
        total = self.polygon_rings().groupBy(F.col("rel_id").alias("id")).agg(F.sum(twice).alias("twice"))
        m = meters_per_unit((F.col("min_y").cast("double") + F.col("max_y")) / 2)
        return ways.unionByName(r.join(total, "id").select("typed_id", (F.col("twice") / 2 * m * m).alias("area")))

    def centroids(self) -> DataFrame:
        """(typed_id, cx, cy) of every feature.

        Areas of relations: outer rings less holes. Other relations: by their areal members if there are any,
        else lineal, else nodes; the middle of the bounds where nothing else applies.
        """
        one = self.df if self.view == "world" else self.df.dropDuplicates(["typed_id"])
        nodes = one.where("type = 0").select("typed_id", F.col("min_x").cast("double").alias("cx"), F.col("min_y").cast("double").alias("cy"))
        ways = spatial.pointed(self.lib, one.where("type = 1")).select("typed_id", self._way_centroid().alias("c"))
        if 2 not in self.kinds:
            return nodes.unionByName(ways.select("typed_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))
        r = one.where("type = 2")
        weighted = self._ring_moments()
        bounds = [((F.col(a).cast("double") + F.col(b)) / 2).alias(c) for a, b, c in (("min_x", "max_x", "cx"), ("min_y", "max_y", "cy"))]
        areas = r.where("is_area").select("typed_id", "id", *bounds).join(weighted, "id", "left").select(
            "typed_id", *[F.when(F.col("a") > 0, F.col(f"m{c}") / F.col("a")).otherwise(F.col(f"c{c}")).alias(f"c{c}") for c in "xy"]
        )
        others = r.where("NOT is_area").select("typed_id", "id", *bounds).join(self._member_moments(r.where("NOT is_area")), "id", "left").select(
            "typed_id", *[F.coalesce(F.col(f"m{c}"), F.col(f"c{c}")).alias(f"c{c}") for c in "xy"]
        )
        return nodes.unionByName(ways.select("typed_id", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))).unionByName(areas).unionByName(others)

    @staticmethod
    def _way_centroid() -> Column:
        ring = measures.ring_centroid(F.col("points"), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y"))
        return F.when(F.col("is_area"), ring).otherwise(measures.line_centroid(F.col("points")))

    def _ring_moments(self) -> DataFrame:
        """(id, a, mx, my): area and area by centroid of area relations, holes taken off."""
        c = measures.ring_centroid(F.col("points"), *[f("points") for f in (_min("x"), _min("y"), _max("x"), _max("y"))])
        sign = F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)
        a = F.abs(measures.shoelace(F.col("points"))) / 2 * sign
        each = self.polygon_rings().select(F.col("rel_id").alias("id"), a.alias("a"), c.alias("c"))
        return each.groupBy("id").agg(F.sum("a").alias("a"), F.sum(F.col("a") * F.col("c.x")).alias("mx"), F.sum(F.col("a") * F.col("c.y")).alias("my"))

    def _member_moments(self, relations: DataFrame) -> DataFrame:
        parts = related.closure(self.lib, relations).where("m_type < 2").select(F.col("root").alias("rel"), F.col("m_typed_id").alias("typed_id"))
        found = self.lib.features.join(parts, "typed_id")
        nodes = found.where("type = 0").select("rel", F.lit(0).alias("rank"), F.lit(1.0).alias("w"), F.col("min_x").cast("double").alias("x"), F.col("min_y").cast("double").alias("y"))
        w = found.where("type = 1")
        lines = spatial.pointed(self.lib, w)
        size = F.when(F.col("is_area"), F.abs(measures.shoelace(F.col("points"))) / 2).otherwise(measures.length(F.col("points")))
        ways = lines.select("rel", F.when(F.col("is_area"), 2).otherwise(1).alias("rank"), size.alias("w"), self._way_centroid().alias("c")).select("rel", "rank", "w", F.col("c.x").alias("x"), F.col("c.y").alias("y"))
        sums = nodes.unionByName(ways).where("w > 0").groupBy("rel", "rank").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("x"), F.sum(F.col("w") * F.col("y")).alias("y"))
        top = sums.groupBy("rel").agg(F.max_by(F.struct("w", "x", "y"), "rank").alias("s"))
        return top.select(F.col("rel").alias("id"), (F.col("s.x") / F.col("s.w")).alias("mx"), (F.col("s.y") / F.col("s.w")).alias("my"))

    # output

    def geometries(self, form: str = "wkt", precision: int = 7) -> DataFrame:
        """(typed_id, geometry) as "wkt", "wkb" or "geojson"; relations that are no areas as collections of their members."""
        if form == "wkb":
            return self.geometries("wkt", max(precision, 9)).withColumn("geometry", wkb("geometry"))
        wkt = form == "wkt"
        one = self.df if self.view == "world" else self.df.dropDuplicates(["typed_id"])

        x, y = F.col("min_x"), F.col("min_y")
        point = formats.wkt_point(x, y, precision) if wkt else formats.geojson_geometry("Point", formats.json_point(x, y, precision))
        line = (formats.wkt_way if wkt else formats.geojson_way)(F.col("points"), F.col("is_area"), precision)

        def points(rows: DataFrame, *keys: str) -> DataFrame:
            return rows.where("type = 0").select(*keys, "typed_id", point.alias("geometry"))

        def lines(rows: DataFrame, *keys: str) -> DataFrame:
            return spatial.pointed(self.lib, rows.where("type = 1")).select(*keys, "typed_id", line.alias("geometry"))

        simple = points(one).unionByName(lines(one))
        if 2 not in self.kinds:
            return simple
        areas = one.where("type = 2 AND is_area").select("typed_id", "id")
        made = formats.polygons(self.polygon_rings(), form, precision).withColumnRenamed("rel_id", "id")
        none = "POLYGON EMPTY" if wkt else '{"type":"Polygon","coordinates":[]}'
        areas = areas.join(made, "id", "left").select("typed_id", F.coalesce("geometry", F.lit(none)).alias("geometry"))
        groups = one.where("type = 2 AND NOT is_area").select("typed_id", "id", "type")
        parts = related.closure(self.lib, groups).select("root", "m_type", F.col("m_typed_id").alias("typed_id"))
        # one join a kind: a semi join would go below the union of a lazy library, once for each of its tables and all in one task
        leaves = [made(self.lib.features.join(parts.where(F.col("m_type") == k).drop("m_type"), "typed_id"), "root") for k, made in enumerate((points, lines))]
        texts = leaves[0].unionByName(leaves[1]).toDF("root", "at", "text").where("text IS NOT NULL")
        texts = _pieces(texts).unionByName(groups.select(F.col("id").alias("root")), allowMissingColumns=True)
        held = texts.groupBy("root").agg(_listed("at", "text").alias("t"))
        if wkt:
            made = F.when(F.col("t") == "", F.lit("GEOMETRYCOLLECTION EMPTY")).otherwise(F.concat(F.lit("GEOMETRYCOLLECTION("), "t", F.lit(")")))
        else:
            made = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), "t", F.lit("]}"))
        return simple.unionByName(areas).unionByName(held.select((F.col("root") * 4 + 2).alias("typed_id"), made.alias("geometry")))

    def geojson(self, precision: int = 7) -> DataFrame:
        """(typed_id, geojson): a GeoJSON Feature each."""
        rows = self.df.join(self.geometries("geojson", precision), "typed_id")
        return rows.select("typed_id", formats.geojson_feature(F.col("geometry"), F.col("tags")).alias("geojson"))

    def rows(self, schema: str, precision: int = 7) -> DataFrame:
        """Columns named by a key schema, all text."""
        keys, df = formats.KeySchema(schema), self.df
        if {"lon", "lat"} & set(keys.columns):
            df = df.join(self.centroids(), "typed_id")
        if "geom" in keys.columns:
            df = df.join(self.geometries("wkt", precision).withColumnRenamed("geometry", "wkt"), "typed_id")
        return keys.select(df, precision)

    def write_csv(self, path: str, schema: str, precision: int = 7) -> None:
        formats.csv_lines(self.rows(schema, precision)).write.text(path)

    def map_html(self, most: int = 10_000, **page) -> str:
        """A Leaflet page of the set: for people, not for pipelines. A set of more than ``most`` features is an error.

        Relations are drawn as their polygons, or else as the nodes and ways among their members, at any depth.
        """
        one = self.df.dropDuplicates(["typed_id"]) if self.view != "world" else self.df
        own = one.select(F.col("typed_id").alias("of"), "typed_id", "type", "is_area", "min_x", "min_y", tags.label().alias("label"), *(["points"] if "points" in one.columns else []), "id")
        some = own.limit(most + 1).count()
        if some > most:
            raise ValueError(f"more than {most} features: narrow the set, or raise most")
        rows = own.where("type < 2")
        polygons: list = []
        if 2 in self.kinds:
            rels = own.where("type = 2")
            parts = related.closure(self.lib, rels.where("NOT is_area")).where("m_type < 2").select((F.col("root") * 4 + 2).alias("of"), F.col("m_typed_id").alias("typed_id"))
            named = parts.join(rels.select("of", "label"), "of")
            rows = rows.unionByName(self.lib.features.join(named, "typed_id").select(*rows.columns))
            polygons = self.polygon_rings().join(rels.where("is_area").select("id", "label"), F.col("rel_id") == F.col("id")).orderBy("rel_id", "polygon", "ring").collect()
        drawn = rows.where("type = 0").withColumn("points", F.array(F.struct(F.col("min_x").alias("x"), F.col("min_y").alias("y"))))
        drawn = drawn.unionByName(spatial.pointed(self.lib, rows.where("type = 1")).select(*drawn.columns))
        at = lambda p: [round(Plane.lat(p["y"]), 7), round(Plane.lon(p["x"]), 7)]
        shapes = []
        for r in drawn.orderBy("of", "typed_id").collect():
            kind = "marker" if r.type == 0 else "polygon" if r.is_area else "polyline"
            shapes.append({"kind": kind, "latlngs": at(r.points[0]) if r.type == 0 else [at(p) for p in r.points], "label": r.label})
        by: dict = {}
        for r in polygons:
            by.setdefault((r.rel_id, r.label), {}).setdefault(r.polygon, []).append([at(p) for p in r.points])
        shapes += [{"kind": "polygon", "latlngs": list(found.values()), "label": label} for (_, label), found in by.items()]
        return formats.leaflet(shapes, **page)


def _listed(order: str, text: str) -> Column:
    """Aggregate of texts that aren't null: joined by commas in order."""
    held = F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text)))
    return F.array_join(F.transform(F.array_sort(held), lambda s: s[text]), ",")


def _pieces(texts: DataFrame) -> DataFrame:
    """(root, at, text) of texts (root, at, text): neighbours by at joined in order, with the high bits of at.

    Joined in steps of PIECE_BITS, a group has at most two to that power of rows, however many members a root has, and
    so has the last step of what is left, for numbers below 2^48; in one step a task would gather a row a member.
    """
    for _ in range(2):
        texts = texts.groupBy("root", F.shiftright("at", PIECE_BITS).alias("high")).agg(_listed("at", "text").alias("text")).withColumnRenamed("high", "at")
    return texts


def wkb(text: str) -> Column:
    @F.arrow_udf("binary")
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else geometry.to_wkb(geometry.parse_wkt(t)) for t in texts.to_pylist()], pa.binary())

    return made(text)


def _min(c: str):
    return lambda points: F.array_min(F.transform(points, lambda p: p[c]))


def _max(c: str):
    return lambda points: F.array_max(F.transform(points, lambda p: p[c]))
