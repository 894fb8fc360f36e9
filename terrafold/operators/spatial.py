"""Spatial tests of whole sets against one test geometry.

A set is first cut to the geometry's bounds by integer comparisons that reach the scan. Nodes are then tested
on their columns, ways on their vertex arrays, relations on the tests of all their members. Rules:

* intersecting: boundaries count. Ways by first vertex, then by segments; areas also if they hold the geometry.
* within: a node strictly inside; a way with no vertex outside and one inside (``strict`` also wants no edge
  to leave); an area whose vertices are all on the boundary if its centroid is inside. Area relations by
  member ways, other relations by all members.
* crossing: ways and relations whose segments meet the geometry's; for a polygon, only those that aren't areas.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures
from ..functions.box import Box
from ..functions.mercator import Plane
from ..sources.library import Library, ordered_points
from .kernel import Shape, each_meets, edges_of, holds, locate, on_edges, segment_distance, side
from .related import closure


class UnsupportedGeometry(ValueError):
    """The operator isn't defined for this kind of geometry."""


def coords(lib: Library, ways: DataFrame) -> DataFrame:
    """(id, points): the vertices of ways (id) in order."""
    ids = ways.select("id").distinct()
    if "points" in lib.features.columns:
        return lib.features.where("type = 1 AND points IS NOT NULL").join(ids, "id", "left_semi").select("id", "points")
    v = lib.way_nodes.join(ids.select(F.col("id").alias("way_id")), "way_id", "left_semi")
    return v.groupBy(F.col("way_id").alias("id")).agg(ordered_points().alias("points"))


def pointed(lib: Library, ways: DataFrame) -> DataFrame:
    """Way rows with their vertices in points: stored with the way, or else gathered."""
    if "points" in ways.columns:
        return ways.where("points IS NOT NULL")
    return ways.join(coords(lib, ways).withColumnRenamed("id", "w"), F.col("id") == F.col("w")).drop("w")


def node_location(shape: Shape):
    """Column function of x and y: 1 inside, 0 on the boundary, -1 outside; for lines and points 0 or -1."""

    @F.pandas_udf("tinyint")
    def at(x: pd.Series, y: pd.Series) -> pd.Series:
        px, py = x.to_numpy("i8"), y.to_numpy("i8")
        if shape.kind == "polygon":
            return pd.Series(locate(px, py, shape.edges))
        if shape.kind == "line":
            return pd.Series(np.where(on_edges(px, py, shape.edges), 0, -1).astype("i1"))
        hit = ((px[:, None] == shape.starts[:, 0][None]) & (py[:, None] == shape.starts[:, 1][None])).any(1)
        return pd.Series(np.where(hit, 0, -1).astype("i1"))

    return at


def unpacked(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All vertices of vertex arrays (n, 2), and where each array starts, with the end: without a Python object each."""
    flat = points.flatten()
    p = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype("i8") for c in ("x", "y")], axis=1) if len(flat) else np.empty((0, 2), "i8")
    return p, np.concatenate([[0], np.cumsum(pc.list_value_length(points).to_numpy(zero_copy_only=False))]).astype("i8")


def all_edges(p: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all arrays, and the number of the array that each is of."""
    owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    inner = owner[1:] == owner[:-1]
    return np.hstack([p[:-1], p[1:]])[inner], owner[1:][inner]


WAY_TEST = "first tinyint, n_in int, n_edge int, n_out int, meets boolean, holds boolean, leaves boolean"


def way_tests(shape: Shape):
    """Column function of points and is_area: a struct of WAY_TEST. All vertices and edges of a batch are tested together."""

    @F.arrow_udf(WAY_TEST)
    def tests(points: pa.Array, area: pa.Array) -> pa.Array:
        p, cuts = unpacked(points)
        n = len(points)
        if shape.kind == "polygon":
            loc = locate(p[:, 0], p[:, 1], shape.edges)
        elif shape.kind == "line":
            loc = np.where(on_edges(p[:, 0], p[:, 1], shape.edges), 0, -1)
        else:
            loc = np.where((p[:, None] == shape.starts[None]).all(2).any(1), 0, -1)
        vertex = np.repeat(np.arange(n), np.diff(cuts))
        e, owner = all_edges(p, cuts)
        of = lambda owners, on: np.bincount(owners[on], minlength=n)
        if shape.kind == "point":
            hit = np.zeros(len(e), bool)
            for x, y in shape.starts.tolist():
                hit |= touched(e, x, y)
        else:
            hit = each_meets(e, shape.edges)
        leaves = of(owner, each_meets(e, shape.edges, through=True)) > 0 if shape.kind == "polygon" else np.zeros(n, bool)
        held = np.zeros(n, bool)
        for k in np.flatnonzero(area.to_numpy(zero_copy_only=False).astype(bool)):
            ring = e[np.searchsorted(owner, k) : np.searchsorted(owner, k, side="right")]
            held[k] = len(ring) and (locate(shape.starts[:, 0], shape.starts[:, 1], ring) >= 0).any()
        first = np.where(np.diff(cuts) > 0, loc[np.minimum(cuts[:-1], max(0, len(loc) - 1))] if len(loc) else -1, -1)
        made = [pa.array(first.astype("i1")), *(pa.array(of(vertex, x).astype("i4")) for x in (loc > 0, loc == 0, loc < 0))]
        made += [pa.array(x.astype(bool)) for x in (of(owner, hit) > 0, held, leaves)]
        return pa.StructArray.from_arrays(made, [c.split()[0] for c in WAY_TEST.split(", ")])

    return tests


def touched(e: np.ndarray, x: int, y: int) -> np.ndarray:
    """Whether a point is on each segment."""
    near_ = (np.minimum(e[:, 0], e[:, 2]) <= x) & (x <= np.maximum(e[:, 0], e[:, 2])) & (np.minimum(e[:, 1], e[:, 3]) <= y) & (y <= np.maximum(e[:, 1], e[:, 3]))
    near_[near_] = side(*(e[near_, k] for k in range(4)), np.int64(x), np.int64(y)) == 0
    return near_


def near(df: DataFrame, shape: Shape) -> DataFrame:
    return df.where(Box(*shape.bounds).touches())


def tested(lib: Library, df: DataFrame, shape: Shape, node_rule, way_rule) -> tuple[DataFrame, DataFrame]:
    """Nodes and ways of df with a column ok: node_rule of the location, way_rule of the struct t."""
    nodes = df.where("type = 0").withColumn("ok", node_rule(node_location(shape)(F.col("min_x"), F.col("min_y"))))
    ways = df.where("type = 1")
    t = way_tests(shape)(F.col("points"), F.col("is_area")).alias("t")
    rows = pointed(lib, ways)
    ways = rows.select(*rows.columns, t).withColumn("ok", way_rule(F.col("t")))
    return nodes, ways


def parts_of(lib: Library, relations: DataFrame) -> DataFrame:
    """(root, m_typed_id, m_type) with the member's own columns; of area relations only direct members."""
    both = closure(lib, relations).select("root", "m_typed_id", "m_type", "m_id")
    direct = lib.members.select(F.col("rel_id").alias("root"), "m_typed_id")
    kinds = relations.select(F.col("id").alias("root"), F.col("is_area").alias("root_area"))
    found = both.join(kinds, "root")
    flat = found.where("NOT root_area").unionByName(found.where("root_area").join(direct.distinct(), ["root", "m_typed_id"], "left_semi"))
    return flat.where("m_type < 2")


ALL = frozenset((0, 1, 2))


def keep(df: DataFrame, kinds: frozenset, nodes: DataFrame, ways: DataFrame, relations) -> DataFrame:
    """The rows that passed, of the kinds that the set can hold: other kinds aren't planned at all."""
    cols, out = df.columns, []
    if 0 in kinds:
        out.append(nodes.where("ok").select(*cols))
    if 1 in kinds:
        out.append(ways.where("ok").select(*cols))
    if 2 in kinds:
        out.append(relations().select(*cols))
    return reduce(DataFrame.unionByName, out) if out else df.where(F.lit(False))


def by_members(lib: Library, df: DataFrame, shape: Shape, node_rule, way_rule, rule, cut: bool = True) -> DataFrame:
    """Relations of df for which rule() holds: an aggregate over members with ok, n_in, n_out, m_type and root_area."""
    rels = df.where("type = 2")
    parts = parts_of(lib, rels)
    found = lib.features.join(parts.select(F.col("m_typed_id").alias("typed_id")).distinct(), "typed_id", "left_semi")
    nodes, ways = tested(lib, near(found, shape) if cut else found, shape, node_rule, way_rule)
    loc = node_location(shape)(F.col("min_x"), F.col("min_y"))
    n = nodes.select(F.col("typed_id").alias("m_typed_id"), "ok", (loc > 0).cast("int").alias("n_in"), (loc < 0).cast("int").alias("n_out"))
    w = ways.select(F.col("typed_id").alias("m_typed_id"), "ok", F.col("t.n_in").alias("n_in"), F.col("t.n_out").alias("n_out"))
    joined = parts.join(n.unionByName(w), "m_typed_id")
    passed = joined.groupBy("root", "root_area").agg(rule().alias("rel_ok")).where("rel_ok").select("root")
    return rels.join(passed, rels.id == passed.root, "left_semi")


def intersecting(lib: Library, df: DataFrame, shape: Shape, kinds: frozenset = ALL) -> DataFrame:
    if shape.kind == "point":
        return containing_point(lib, df, int(shape.starts[0][0]), int(shape.starts[0][1]), kinds) if len(shape.starts) else df.where(F.lit(False))
    inside = near(df, shape)
    node_rule, way_rule = (lambda at: at >= 0), (lambda t: (t["first"] >= 0) | t["meets"] | t["holds"])
    nodes, ways = tested(lib, inside, shape, node_rule, way_rule)

    def rels() -> DataFrame:
        direct = by_members(lib, inside, shape, node_rule, way_rule, lambda: F.bool_or("ok"))
        found = direct.select("typed_id").union(area_relations_holding(lib, inside, shape.starts).select("typed_id")).distinct()
        return inside.where("type = 2").join(found, "typed_id", "left_semi")

    return keep(df, kinds, nodes, ways, rels)


def area_relations_holding(lib: Library, df: DataFrame, points: np.ndarray) -> DataFrame:
    """Area relations that hold one of a few points: crossings of their member ways' edges are counted together."""
    rels = df.where("type = 2 AND is_area")
    ways = lib.members.where("m_type = 1").join(rels.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select("rel_id", F.col("m_id").alias("id"))
    lines = ways.join(coords(lib, ways.select("id").distinct()), "id")

    @F.arrow_udf("array<struct<n:int,edge:boolean>>")
    def crossings(points_: pa.Array) -> pa.Array:
        p, cuts = unpacked(points_)
        e, owner = all_edges(p, cuts)
        n, k = len(points_), len(points)
        crossed, edge = np.zeros((n, k), "i4"), np.zeros((n, k), bool)
        for j, (x, y) in enumerate(points.tolist()):
            crossed[:, j] = np.bincount(owner, crosses_ray(e, x, y), n) % 2
            edge[:, j] = np.bincount(owner[touched(e, x, y)], minlength=n) > 0
        flat = pa.StructArray.from_arrays([pa.array(crossed.ravel()), pa.array(edge.ravel())], ["n", "edge"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * k), flat)

    found = lines.select("rel_id", F.posexplode(crossings("points")).alias("k", "c")).groupBy("rel_id", "k").agg((F.sum("c.n") % 2 == 1).alias("odd"), F.bool_or("c.edge").alias("edge"))
    hit = found.where("odd OR edge").select("rel_id").distinct()
    return rels.join(hit, rels.id == hit.rel_id, "left_semi")


def crosses_ray(e: np.ndarray, x: int, y: int) -> np.ndarray:
    """1 for each segment that a ray from a point crosses."""
    rows = (np.minimum(e[:, 1], e[:, 3]) <= y) & (y < np.maximum(e[:, 1], e[:, 3]))
    out = np.zeros(len(e))
    s = side(*(e[rows, k] for k in range(4)), np.int64(x), np.int64(y))
    up = e[rows, 1] < e[rows, 3]
    out[rows] = np.where(up, s > 0, s < 0)
    return out


def containing(lib: Library, df: DataFrame, shape: Shape, kinds: frozenset = ALL) -> DataFrame:
    """Areas that hold a whole geometry, boundaries included: its vertices, and its edges between them.

    Lines hold geometries that lie on them and nodes a point at them; other relations never hold any.
    """
    if not len(shape.starts):
        return df.where(F.lit(False))
    if shape.kind == "point" and len(shape.starts) == 1:
        return containing_point(lib, df, int(shape.starts[0][0]), int(shape.starts[0][1]), kinds)
    low_x, low_y, high_x, high_y = shape.bounds
    at = df.where((F.col("min_x") <= low_x) & (F.col("max_x") >= high_x) & (F.col("min_y") <= low_y) & (F.col("max_y") >= high_y))

    @F.arrow_udf("boolean")
    def held(points: pa.Array, area: pa.Array) -> pa.Array:
        p, cuts = unpacked(points)
        out = []
        for a, b, is_area in zip(cuts, cuts[1:], area.to_pylist(), strict=False):
            ring = edges_of(p[a:b])
            out.append(holds(ring, shape) if is_area else lies_on(ring, shape))
        return pa.array(out, pa.bool_())

    def member_ways(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [edges_of(np.stack([np.asarray(x, "i8"), np.asarray(y, "i8")], axis=1)) for x, y in zip(pdf["xs"], pdf["ys"], strict=True)]
        return pd.DataFrame({"id": [key[0]] if holds(np.concatenate(rings), shape) else []}).astype("int64")

    ok = F.lit(True).alias("ok")
    w = pointed(lib, at.where("type = 1"))
    ways = w.where(held("points", "is_area")).select("*", ok)
    nodes = at.where("type = 0").select("*", (F.lit(low_x == high_x) & F.lit(low_y == high_y)).alias("ok"))

    def relations() -> DataFrame:
        rels = at.where("type = 2 AND is_area")
        of = lib.members.where("m_type = 1").join(rels.select(F.col("id").alias("rel_id")), "rel_id", "left_semi").select("rel_id", F.col("m_id").alias("id"))
        xs, ys = F.transform("points", lambda p: p["x"]).alias("xs"), F.transform("points", lambda p: p["y"]).alias("ys")
        lines = of.join(coords(lib, of.select("id")), "id").select("rel_id", xs, ys)
        hit = lines.groupBy("rel_id").applyInPandas(member_ways, "id long")  # a group is the boundary of one feature
        return rels.join(hit, "id", "left_semi")

    return keep(df, kinds, nodes, ways, relations)


def lies_on(line: np.ndarray, shape: Shape) -> bool:
    """Whether a line runs through all points of a shape, between vertices too."""
    if shape.kind == "polygon" or not len(line):
        return False
    points = inside_points(shape, np.concatenate([line, line[-1:, [2, 3, 2, 3]]]))
    return bool(on_edges(points[:, 0], points[:, 1], 2 * line).all())


def within(lib: Library, df: DataFrame, shape: Shape, strict: bool = False, kinds: frozenset = ALL) -> DataFrame:
    if shape.kind != "polygon":
        raise UnsupportedGeometry("within needs a polygon")
    box = Box(*shape.bounds)
    inside = df.where((F.col("min_x") >= box.min_x) & (F.col("max_x") <= box.max_x) & (F.col("min_y") >= box.min_y) & (F.col("max_y") <= box.max_y))
    node_rule = lambda at: at > 0
    way_rule = lambda t: (t["n_out"] == 0) & (t["n_in"] > 0) & (~t["leaves"] if strict else F.lit(True))
    nodes, ways = tested(lib, inside, shape, node_rule, way_rule)
    # areas whose vertices are all on the boundary: by their centroid
    box_ = [F.col(c) for c in ("min_x", "min_y", "max_x", "max_y")]
    edge_only = F.col("is_area") & (F.col("t.n_out") == 0) & (F.col("t.n_in") == 0)
    center = F.when(edge_only, measures.ring_centroid(F.col("points"), *box_))
    at_center = node_location(shape)(F.coalesce(F.round(center["x"]).cast("int"), F.col("min_x")), F.coalesce(F.round(center["y"]).cast("int"), F.col("min_y")))
    ways = ways.withColumn("ok", F.col("ok") | (edge_only & (at_center > 0)))

    def rule() -> Column:
        line = (F.col("m_type") == 1) | ~F.col("root_area")
        return (F.sum(F.when(line, F.col("n_out")).otherwise(0)) == 0) & (F.sum(F.when(line, F.col("n_in")).otherwise(0)) > 0)

    return keep(df, kinds, nodes, ways, lambda: by_members(lib, inside, shape, node_rule, way_rule, rule, cut=False))


def crossing(lib: Library, df: DataFrame, shape: Shape, kinds: frozenset = ALL) -> DataFrame:
    if shape.kind == "point":
        raise UnsupportedGeometry("nothing crosses a point")
    inside = near(df, shape).where("type > 0")
    if shape.kind == "polygon":
        inside = inside.where("NOT is_area")
    nodes, ways = tested(lib, inside, shape, lambda at: F.lit(False), lambda t: t["meets"])
    return keep(df, kinds - {0}, nodes, ways, lambda: by_members(lib, inside, shape, lambda at: F.lit(False), lambda t: t["meets"], lambda: F.bool_or("ok")))


def containing_point(lib: Library, df: DataFrame, x: int, y: int, kinds: frozenset = ALL) -> DataFrame:
    """Areas with the point inside or on the boundary, lines through it, nodes at it; other relations never."""
    at = df.where(Box(x, y, x, y).touches())
    shape = Shape.of("point", [np.asarray([[x, y]])])
    nodes, ways = tested(lib, at, shape, lambda loc: loc >= 0, lambda t: t["meets"] | t["holds"])
    return keep(df, kinds, nodes, ways, lambda: area_relations_holding(lib, at, shape.starts))


def max_meters_from(lib: Library, df: DataFrame, meters: float, x: int, y: int, kinds: frozenset = ALL) -> DataFrame:
    """Features less than a distance from a point, measured in the plane by the scale at the point; areas also if they hold it."""
    units = Plane.units(meters, y)
    box = Box.around(x, y, int(units) + 1)
    at = df.where(box.touches())
    d2 = lambda a, b: (a.cast("double") - x) * (a.cast("double") - x) + (b.cast("double") - y) * (b.cast("double") - y)
    close = lambda rows: rows.where("type = 0").where(d2(F.col("min_x"), F.col("min_y")) < units * units)

    @F.arrow_udf("boolean")
    def line_near(points: pa.Array, area: pa.Array) -> pa.Array:
        p, cuts = unpacked(points)
        e, owner = all_edges(p, cuts)
        n = len(points)
        hit = np.bincount(owner[segment_distance(x, y, e) < units], minlength=n) > 0
        held = (np.bincount(owner, crosses_ray(e, x, y), n) % 2 == 1) | (np.bincount(owner[touched(e, x, y)], minlength=n) > 0)
        return pa.array(hit | (held & area.to_numpy(zero_copy_only=False).astype(bool)))

    def lines(rows: DataFrame) -> DataFrame:
        return pointed(lib, rows.where("type = 1")).where(line_near("points", "is_area")).select(*rows.columns)

    def relations() -> DataFrame:
        rels = at.where("type = 2")
        parts = closure(lib, rels).where("m_type < 2").select(F.col("root").alias("id"), F.col("m_typed_id").alias("typed_id"))
        members = lib.features.join(parts.select("typed_id").distinct(), "typed_id", "left_semi").where(box.touches())
        hits = close(members).select("typed_id").union(lines(members).select("typed_id"))
        passed = parts.join(hits, "typed_id", "left_semi").select("id")
        hold = area_relations_holding(lib, at, np.asarray([[x, y]])).select("id")
        return rels.join(passed.union(hold).distinct(), "id", "left_semi")

    ok = F.lit(True).alias("ok")
    return keep(df, kinds, close(at).select("*", ok), lines(at).select("*", ok), relations)
