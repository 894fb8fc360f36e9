"""Named queries over the star-schema tables, one an operator, and their SQL twins."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import box as boxes
from ..functions import formats, measures, mercator, tags
from ..functions.box import Box
from ..functions.mercator import EARTH_CIRCUMFERENCE, MAP_WIDTH, Plane
from ..operators import related, spatial
from ..operators.features import Features
from ..operators.kernel import Shape
from ..operators.spatial_join import points_in_polygons
from ..sources.star import NATIONS, PARTS, REGIONS, SUPPLIERS, open_star
from . import oracle as o

#: A concave test polygon, a test line and a box.
RING = [(-1500000000, -1200000000), (1200000000, -1000000000), (200000000, 0), (1500000000, 1100000000), (-1200000000, 900000000), (-400000000, -100000000), (-1500000000, -1200000000)]
LINE = [(-1900000000, -1400000000), (0, 100000000), (1900000000, 1300000000)]
BOX = Box(-800000000, -600000000, 700000000, 900000000)
POINT = (500000000, -200000000)
#: A line within one nation's rectangle.
INNER = [(-1900000000, -1400000000), (-1500000000, -1000000000), (-1300000000, -1450000000)]
METERS = 1500000.0

_QUERIES: dict = {}
_ON_WORLD: dict = {}
_SQL: dict = {}


def world(spark: SparkSession, sf_dir: str) -> Features:
    return Features.of(open_star(spark, sf_dir))


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of the world; sql is what follows the prelude's tables."""

    def add(fn):
        _ON_WORLD[name] = fn
        _QUERIES[name] = lambda spark, sf_dir: fn(world(spark, sf_dir))
        if sql:
            _SQL[name] = f"{o.PRELUDE}{', ' + ctes if ctes else ''}\n{sql}"
        return fn

    return add


def ids(f: Features | DataFrame) -> DataFrame:
    df = f.df if isinstance(f, Features) else f
    return df.select(F.col("type").cast("int").alias("type"), "id")


def select_ids(where: str) -> str:
    return f"SELECT type, id FROM features WHERE {where}"


polygon = lambda: Shape.of("polygon", [np.asarray(RING)])
line = lambda: Shape.of("line", [np.asarray(LINE)])

# tag queries

TAG_QUERIES = {
    "tag_type_nodes": ("n", "type = 0"),
    "tag_type_areas": ("a", "is_area"),
    "tag_type_way_or_relation": ("wr", "(type = 1 OR type = 2) AND NOT is_area"),
    "tag_key": ("n[mktsegment]", "type = 0 AND coalesce(tags['mktsegment'] <> 'no', false)"),
    "tag_not_key": ("n[!mktsegment]", "type = 0 AND coalesce(tags['mktsegment'], 'no') = 'no'"),
    "tag_eq": ("n[mktsegment=BUILDING]", "type = 0 AND " + o.text("mktsegment", "@ = 'BUILDING'")),
    "tag_eq_list": ("[mktsegment=BUILDING,MACHINERY]", o.text("mktsegment", "@ IN ('BUILDING', 'MACHINERY')")),
    "tag_ne": ("n[mktsegment!=BUILDING]", "type = 0 AND NOT " + o.text("mktsegment", "@ = 'BUILDING'")),
    "tag_ne_list": ("n[brand][brand!='Brand#11','Brand#23']", "type = 0 AND tags['brand'] IS NOT NULL AND NOT " + o.text("brand", "@ IN ('Brand#11', 'Brand#23')")),
    "tag_num_cmp": ("n[size>=20]", "type = 0 AND " + o.numeric("size", ">= 20")),
    "tag_num_lt": ("n[acctbal<0]", "type = 0 AND " + o.numeric("acctbal", "< 0")),
    "tag_num_eq_lenient": ("n[size=5]", "type = 0 AND " + o.numeric("size", "= 5")),
    "tag_text_skips_numbers": ("n[size='5','5 mm']", "type = 0 AND " + o.text("size", "@ IN ('5', '5 mm')")),
    "tag_mixed_list": ("n[size=7,'n/a']", "type = 0 AND (" + o.numeric("size", "= 7") + " OR " + o.text("size", "@ = 'n/a'") + ")"),
    "tag_prefix": ("n[type=STANDARD*]", "type = 0 AND " + o.text("type", "starts_with(@, 'STANDARD')")),
    "tag_suffix": ("n[size='* mm']", "type = 0 AND " + o.text("size", "ends_with(@, ' mm')")),
    "tag_contains": ("n[name='*0001*']", "type = 0 AND " + o.text("name", "contains(@, '0001')")),
    "tag_regex": ('w[priority~"[12]-.*"]', "type = 1 AND NOT is_area AND " + o.text("priority", "regexp_full_match(@, '[12]-.*')")),
    "tag_not_regex": ('w[priority!~"[12]-.*"]', "type = 1 AND NOT is_area AND NOT " + o.text("priority", "regexp_full_match(@, '[12]-.*')")),
    "tag_and": ("w[priority='1-URGENT'][status=F]", "type = 1 AND NOT is_area AND " + o.text("priority", "@ = '1-URGENT'") + " AND " + o.text("status", "@ = 'F'")),
    "tag_or_selectors": ("n[mktsegment=BUILDING],w[status=O],a[boundary]", "(type = 0 AND " + o.text("mktsegment", "@ = 'BUILDING'") + ") OR (type = 1 AND NOT is_area AND " + o.text("status", "@ = 'O'") + ") OR (is_area AND tags['boundary'] IS NOT NULL)"),
    "tag_same_key_range": ("n[size>10][size<20]", "type = 0 AND " + o.numeric("size", "> 10") + " AND " + o.numeric("size", "< 20")),
    "tag_any_text": ("n[size=*]", "type = 0 AND " + o.text("size", "@ IS NOT NULL")),
}
for _name, (_q, _where) in TAG_QUERIES.items():
    query(_name, select_ids(_where))(lambda f, q=_q: ids(f(q)))


@query("tag_chained", select_ids("type = 0 AND tags['acctbal'] IS NOT NULL AND " + o.numeric("acctbal", "> 5000") + " AND tags['supplier'] IS NULL"))
def tag_chained(f: Features) -> DataFrame:
    return ids(f("n[acctbal]")("*[acctbal>5000]")("[!supplier]"))


@query("typed_views", "SELECT type, count(*) AS n FROM features GROUP BY 1")
def typed_views(f: Features) -> DataFrame:
    rows = [g.df.groupBy().agg(F.lit(k).alias("type"), F.count("*").alias("n")) for k, g in enumerate((f.nodes(), f.ways(), f.relations()))]
    return rows[0].union(rows[1]).union(rows[2])


@query("waynode_flagged", select_ids("is_waynode"))
def waynode_flagged(f: Features) -> DataFrame:
    return ids(f.df.where("is_waynode"))


# boxes and shapes


_IN_BOX = f"max_x >= {BOX.min_x} AND min_x <= {BOX.max_x} AND max_y >= {BOX.min_y} AND min_y <= {BOX.max_y}"


@query("bbox", select_ids(_IN_BOX))
def bbox(f: Features) -> DataFrame:
    return ids(f(BOX))


@query("bbox_antimeridian", select_ids("(max_x >= 1500000000 OR min_x <= -1500000000) AND max_y >= -600000000 AND min_y <= 900000000"))
def bbox_antimeridian(f: Features) -> DataFrame:
    return ids(f(Box(1500000000, -600000000, -1500000000, 900000000)))


@query("bbox_point", select_ids(f"{POINT[0]} BETWEEN min_x AND max_x AND {POINT[1]} BETWEEN min_y AND max_y"))
def bbox_point(f: Features) -> DataFrame:
    return ids(f(POINT))


@query("bbox_tag_counts", f"SELECT CAST(sum(CASE WHEN tags['name'] IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS named, CAST(sum(CASE WHEN tags['brand'] IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS branded, CAST(sum(CASE WHEN tags['status'] IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS with_status FROM features WHERE {_IN_BOX}")
def bbox_tag_counts(f: Features) -> DataFrame:
    return f(BOX).df.agg(*[F.count_if(tags.has_tag(k)).alias(n) for k, n in (("name", "named"), ("brand", "branded"), ("status", "with_status"))])


_POLY = o.edges_sql(RING)
_NODE_LOC = "loc AS (" + o.located("SELECT id, min_x AS x, min_y AS y FROM features WHERE type = 0", "id") + ")"
_WAY_LOC = "vloc AS (" + o.located("SELECT way_id, seq, x, y FROM way_nodes", "way_id, seq") + ")"
_MEETS = f"meets AS (SELECT DISTINCT way_id FROM segments, poly WHERE {o.CROSSING})"
_CENTER = "cloc AS (" + o.located("SELECT id, (min_x + max_x) // 2 AS x, (min_y + max_y) // 2 AS y FROM features WHERE type = 1 AND is_area", "id") + ")"


@query("within_polygon_nodes", "SELECT id FROM loc WHERE loc > 0", f"{_POLY}, {_NODE_LOC}")
def within_polygon_nodes(f: Features) -> DataFrame:
    return f.nodes().within(polygon()).df.select("id")


@query("within_polygon_ways", "SELECT way_id AS id FROM vloc GROUP BY 1 HAVING min(loc) >= 0 AND max(loc) > 0", f"{_POLY}, {_WAY_LOC}")
def within_polygon_ways(f: Features) -> DataFrame:
    return f.ways().within(polygon()).df.select("id")


_BIG = [(-2000000000, -1500000000), (900000000, -1500000000), (900000000, 1400000000), (-2000000000, 1400000000), (-2000000000, -1500000000)]


@query("within_relation", "SELECT m.rel_id AS id FROM members m JOIN way_nodes w ON m.m_type = 1 AND w.way_id = m.m_id GROUP BY 1 HAVING max(x) <= 900000000 AND max(y) <= 1400000000")
def within_relation(f: Features) -> DataFrame:
    big = Shape.of("polygon", [np.asarray(_BIG)])
    # bounds of nations also cover members far off, so the relations are tested without the box
    rel = f.relations("a")
    rule = lambda: (F.sum(F.when(F.col("m_type") == 1, F.col("n_out")).otherwise(0)) == 0) & (F.sum(F.when(F.col("m_type") == 1, F.col("n_in")).otherwise(0)) > 0)
    return spatial.by_members(f.lib, rel.df, big, lambda at: at > 0, lambda t: t["n_out"] == 0, rule, cut=False).select("id")


@query("intersects_polygon", "SELECT type, id FROM features WHERE (type = 0 AND id IN (SELECT id FROM loc WHERE loc >= 0)) OR (type = 1 AND (id IN (SELECT way_id FROM vloc WHERE loc >= 0) OR id IN (SELECT way_id FROM meets)))", f"{_POLY}, {o.SEGMENTS}, {_NODE_LOC}, {_WAY_LOC}, {_MEETS}")
def intersects_polygon(f: Features) -> DataFrame:
    return ids(f.nodes().intersecting(polygon())).union(ids(f.ways().intersecting(polygon())))


_LINE = o.edges_sql(LINE)


@query("intersects_line", "SELECT type, id FROM features WHERE (type = 0 AND id IN (SELECT id FROM loc WHERE loc = 0)) OR (type = 1 AND id IN (SELECT way_id FROM meets))", f"{_LINE}, {o.SEGMENTS}, {_NODE_LOC}, {_MEETS}")
def intersects_line(f: Features) -> DataFrame:
    return ids(f.nodes().intersecting(line())).union(ids(f.ways().intersecting(line())))


@query("crosses_polygon", "SELECT id FROM features WHERE type = 1 AND NOT is_area AND id IN (SELECT way_id FROM meets)", f"{_POLY}, {o.SEGMENTS}, {_MEETS}")
def crosses_polygon(f: Features) -> DataFrame:
    return f.ways().crossing(polygon()).df.select("id")


@query("crosses_line", "SELECT id FROM features WHERE type = 1 AND id IN (SELECT way_id FROM meets)", f"{_LINE}, {o.SEGMENTS}, {_MEETS}")
def crosses_line(f: Features) -> DataFrame:
    return f.ways().crossing(line()).df.select("id")


@query("containing_line", f"SELECT 1 AS type, id FROM areas WHERE {min(x for x, _ in INNER)} >= min_x AND {max(x for x, _ in INNER)} <= max_x AND {min(y for _, y in INNER)} >= min_y AND {max(y for _, y in INNER)} <= max_y UNION ALL SELECT 2, id - {NATIONS} FROM areas WHERE {min(x for x, _ in INNER)} >= min_x AND {max(x for x, _ in INNER)} <= max_x AND {min(y for _, y in INNER)} >= min_y AND {max(y for _, y in INNER)} <= max_y")
def containing_line(f: Features) -> DataFrame:
    return ids(f("a").containing(Shape.of("line", [np.asarray(INNER)])))


@query("contains_point", f"SELECT 1 AS type, id FROM areas WHERE {POINT[0]} BETWEEN min_x AND max_x AND {POINT[1]} BETWEEN min_y AND max_y UNION ALL SELECT 2, id - {NATIONS} FROM areas WHERE {POINT[0]} BETWEEN min_x AND max_x AND {POINT[1]} BETWEEN min_y AND max_y")
def contains_point(f: Features) -> DataFrame:
    return ids(f("a").containing(*POINT))


@query("containing_feature", f"SELECT id FROM areas a WHERE EXISTS (SELECT 1 FROM features f WHERE f.type = 0 AND f.id = 1 AND f.min_x BETWEEN a.min_x AND a.max_x AND f.min_y BETWEEN a.min_y AND a.max_y)")
def containing_feature(f: Features) -> DataFrame:
    return f.ways("a").containing(f.nodes().filter(F.col("id") == 1)).df.select("id")


_UNITS = Plane.units(METERS, POINT[1])


@query("max_meters_nodes", f"SELECT id FROM features WHERE type = 0 AND (CAST(min_x AS DOUBLE) - {POINT[0]}) * (CAST(min_x AS DOUBLE) - {POINT[0]}) + (CAST(min_y AS DOUBLE) - {POINT[1]}) * (CAST(min_y AS DOUBLE) - {POINT[1]}) < {_UNITS * _UNITS!r}")
def max_meters_nodes(f: Features) -> DataFrame:
    return f.nodes().max_meters_from(METERS, *POINT).df.select("id")


_T = "least(1, greatest(0, CASE WHEN n > 0 THEN (px * dx + py * dy) / n ELSE 0 END))"


@query(
    "max_meters_ways",
    f"""SELECT DISTINCT way_id AS id FROM (SELECT way_id, sx, sy, dx, dy, px, py, {_T} AS t FROM (SELECT way_id, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy, CAST(nx - sx AS DOUBLE) AS dx, CAST(ny - sy AS DOUBLE) AS dy,
    CAST({POINT[0]} - sx AS DOUBLE) AS px, CAST({POINT[1]} - sy AS DOUBLE) AS py, CAST(nx - sx AS DOUBLE) * CAST(nx - sx AS DOUBLE) + CAST(ny - sy AS DOUBLE) * CAST(ny - sy AS DOUBLE) AS n FROM segments))
    WHERE sqrt((t * dx - px) * (t * dx - px) + (t * dy - py) * (t * dy - py)) < {_UNITS!r}
    UNION SELECT id FROM areas WHERE {POINT[0]} BETWEEN min_x AND max_x AND {POINT[1]} BETWEEN min_y AND max_y""",
    o.SEGMENTS,
)
def max_meters_ways(f: Features) -> DataFrame:
    return f.ways().max_meters_from(METERS, *POINT).df.select("id")


def area_polygons(f: Features) -> DataFrame:
    return spatial.coords(f.lib, f.ways("a[boundary]").df.select("id"))


@query("spatial_join_nodes_in_areas", "SELECT a.id AS polygon, count(*) AS n FROM areas a JOIN features f ON f.type = 0 AND f.tags['mktsegment'] IS NOT NULL AND f.min_x > a.min_x AND f.min_x < a.max_x AND f.min_y > a.min_y AND f.min_y < a.max_y GROUP BY 1")
def spatial_join_nodes_in_areas(f: Features) -> DataFrame:
    found = points_in_polygons(f.nodes().df.where(tags.has_tag("mktsegment")).select("id", "min_x", "min_y"), area_polygons(f))
    return found.groupBy("polygon").agg(F.count("*").alias("n"))


@query("spatial_semi_join_areas", f"SELECT id FROM areas a WHERE EXISTS (SELECT 1 FROM features f WHERE f.type = 0 AND f.tags['supplier'] IS NOT NULL AND f.min_x > a.min_x AND f.min_x < a.max_x AND f.min_y > a.min_y AND f.min_y < a.max_y)")
def spatial_semi_join_areas(f: Features) -> DataFrame:
    found = points_in_polygons(f.nodes("n[supplier]").df.select("id", "min_x", "min_y"), area_polygons(f))
    return f.ways("a").df.join(found.select(F.col("polygon").alias("id")), "id", "left_semi").select("id")


# relationships

_ALL_WAYS = "way_id < 1000000"


@query("way_nodes", f"SELECT way_id, seq, node_id AS id, (node_id - {PARTS}) % 3 <> 0 AS anonymous FROM way_nodes WHERE {_ALL_WAYS}")
def way_nodes(f: Features) -> DataFrame:
    return f.ways("w").way_nodes().df.select("way_id", "seq", "id", F.col("typed_id").isNull().alias("anonymous"))


@query("members", "SELECT rel_id, seq, m_type AS type, m_id AS id, role FROM members")
def members(f: Features) -> DataFrame:
    return f.relations().members().df.select("rel_id", "seq", F.col("type").cast("int").alias("type"), "id", "role")


@query("parents_ways", f"SELECT DISTINCT node_id AS child, way_id AS id FROM way_nodes JOIN (SELECT id AS node FROM features WHERE type = 0) ON node = node_id WHERE {_ALL_WAYS}")
def parents_ways(f: Features) -> DataFrame:
    return related.parent_ways(f.lib, f.nodes().df).select(F.expr("child div 4").alias("child"), "id")


@query("parents_relations", "SELECT m_id AS child, rel_id AS id FROM members WHERE m_type = 0")
def parents_relations(f: Features) -> DataFrame:
    return f.nodes().parents("r[type=collection],a").df.select(F.expr("child div 4").alias("child"), "id")


@query("nodes_of_set", f"SELECT DISTINCT id FROM features JOIN way_nodes ON type = 0 AND id = node_id WHERE {_ALL_WAYS} AND " + o.text("size", "ends_with(@, ' mm')"))
def nodes_of_set(f: Features) -> DataFrame:
    return f("n[size='* mm']").nodes_of(f.ways("w")).df.select("id")


@query("parents_of_set", "SELECT id FROM features WHERE type = 2 AND id IN (SELECT rel_id FROM members JOIN (SELECT id AS node FROM features WHERE type = 0 AND " + o.text("mktsegment", "@ = 'BUILDING'") + ") ON m_type = 0 AND m_id = node)")
def parents_of_set(f: Features) -> DataFrame:
    return f.relations().parents_of(f("n[mktsegment=BUILDING]")).df.select("id")


@query("connected_to", "SELECT DISTINCT way_id AS id FROM way_nodes WHERE way_id IN (SELECT id FROM ways WHERE NOT " + o.text("status", "@ = 'F'") + ") AND (x, y) IN (SELECT (x, y) FROM way_nodes WHERE way_id IN (SELECT id FROM ways WHERE " + o.text("status", "@ = 'F'") + "))")
def connected_to(f: Features) -> DataFrame:
    return f.ways("w").connected_to(f.ways("w[status=F]")).df.select("id")


@query("way_feature_nodes", f"SELECT way_id, seq, node_id AS id FROM way_nodes JOIN features ON type = 0 AND id = node_id WHERE way_id < 1000000 AND " + o.numeric("size", "> 40"))
def way_feature_nodes(f: Features) -> DataFrame:
    return f.ways("w").way_nodes("n[size>40]").df.select("way_id", "seq", "id")


@query("members_role", "SELECT rel_id, m_id AS id FROM members WHERE role IN ('supplier', 'outer')")
def members_role(f: Features) -> DataFrame:
    return f.relations().members().with_role("supplier", "outer").df.select("rel_id", "id")


@query("parents_all", f"SELECT type, id FROM (SELECT DISTINCT 1 AS type, way_id AS id FROM way_nodes WHERE node_id IN ({PARTS + 3}, {PARTS + 6}) UNION SELECT DISTINCT 2, rel_id FROM members WHERE m_type = 0 AND m_id IN (5, {SUPPLIERS + 1}))")
def parents_all(f: Features) -> DataFrame:
    some = f.nodes().filter(F.col("id").isin(PARTS + 3, PARTS + 6, 5, SUPPLIERS + 1))
    return ids(some.parents()).distinct()


@query("parents_of_anonymous", f"SELECT DISTINCT way_id AS id FROM way_nodes WHERE x = {((PARTS + 1) * 7919 + 17) % 4000 * 1000000 - 2000000000} AND y = {((PARTS + 1) * 104729 + 31) % 3000 * 1000000 - 1500000000}")
def parents_of_anonymous(f: Features) -> DataFrame:
    place = f.lib.way_nodes.where(F.col("node_id") == PARTS + 1).limit(1)
    bare = place.select(F.lit(0).cast("tinyint").alias("type"), F.col("node_id").alias("id"), F.lit(None).cast("bigint").alias("typed_id"), F.col("x").alias("min_x"), F.col("y").alias("min_y"))
    return related.parent_ways(f.lib, bare).select("id").distinct()


@query("members_of_set", "SELECT id FROM features WHERE type = 0 AND id IN (SELECT m_id FROM members JOIN nations n ON rel_id = n.id WHERE m_type = 0 AND n.tags['name'] = 'NATION_7') AND " + o.text("mktsegment", "@ = 'BUILDING'"))
def members_of_set(f: Features) -> DataFrame:
    return f("n[mktsegment=BUILDING]").members_of(f.relations("a[name='NATION_7']")).df.select("id")


@query("member_closure", f"SELECT n_regionkey + {REGIONS} AS root, CAST(sum(c) + count(*) AS BIGINT) AS n FROM nation JOIN (SELECT rel_id, count(*) AS c FROM members WHERE rel_id < {REGIONS} GROUP BY 1) m ON rel_id = n_nationkey GROUP BY 1")
def member_closure(f: Features) -> DataFrame:
    regions = f.relations().filter(F.col("id") >= REGIONS)
    return related.closure(f.lib, regions.df).groupBy("root").agg(F.count("*").alias("n"))


@query("intersection_of_sets", select_ids(_IN_BOX + " AND " + o.text("mktsegment", "@ = 'MACHINERY'")))
def intersection_of_sets(f: Features) -> DataFrame:
    return ids(f("n[mktsegment=MACHINERY]") & f(BOX))


@query("shared_location", "SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY min_x, min_y) AS c FROM features WHERE type = 0) WHERE c > 1")
def shared_location(f: Features) -> DataFrame:
    return f.sharing_location().df.select("id")


@query("coarse_shared_location", "SELECT id, CAST(c AS BIGINT) AS n FROM (SELECT id, count(*) OVER (PARTITION BY floor(min_x / 4e7), floor(min_y / 4e7)) AS c FROM features WHERE type = 0 AND tags['supplier'] IS NOT NULL) WHERE c > 1")
def coarse_shared_location(f: Features) -> DataFrame:
    nodes = f.nodes("n[supplier]").df.select("id", F.floor(F.col("min_x") / 4e7).alias("x"), F.floor(F.col("min_y") / 4e7).alias("y"))
    places = nodes.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1")
    return nodes.join(places, ["x", "y"]).select("id", "n")


@query("orphans", "SELECT id FROM features WHERE type = 0 AND len(map_keys(tags)) = 0 AND NOT is_waynode AND NOT is_member")
def orphans(f: Features) -> DataFrame:
    return f.orphans().df.select("id")


@query("predicate_filter", "SELECT id FROM features WHERE type = 0 AND length(coalesce(tags['name'], '')) % 2 = 0")
def predicate_filter(f: Features) -> DataFrame:
    def even(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([len(dict(t or ()).get("name", "")) % 2 == 0 for t in pdf["tags"]], dtype=bool)

    return f.nodes().filter(even).df.select("id")


# terminals


@query("count", "SELECT count(*) AS n FROM features")
def count(f: Features) -> DataFrame:
    return f.df.agg(F.count("*").alias("n"))


@query("is_empty", "SELECT true AS none, false AS some")
def is_empty(f: Features) -> DataFrame:
    return f.lib.spark.range(1).select(F.lit(f("n[nosuchkey]").is_empty()).alias("none"), F.lit(f("a").is_empty()).alias("some"))


@query("first_member", "SELECT m_id AS id FROM members WHERE rel_id = 9 ORDER BY seq LIMIT 1")
def first_member(f: Features) -> DataFrame:
    return f.relations().filter(F.col("id") == 9).members().df.orderBy("seq").limit(1).select("id")


@query("one", "SELECT id FROM areas WHERE tags['name'] = (SELECT n_name FROM nation WHERE n_nationkey = 4)")
def one(f: Features) -> DataFrame:
    name = f.relations().filter(F.col("id") == 4).one().tags["name"]
    row = f.ways(f"a[name='{name}']").one()
    return f.lib.spark.range(1).select(F.lit(row.id).cast("bigint").alias("id"))


@query("id_hash", "SELECT bit_xor(id) AS h FROM features")
def id_hash(f: Features) -> DataFrame:
    return f.df.agg(F.bit_xor("id").alias("h"))


@query("xy_hash", "SELECT bit_xor(CAST(min_x AS BIGINT)) AS hx, bit_xor(CAST(max_y AS BIGINT)) AS hy FROM features")
def xy_hash(f: Features) -> DataFrame:
    return f.df.agg(F.bit_xor(F.col("min_x").cast("long")).alias("hx"), F.bit_xor(F.col("max_y").cast("long")).alias("hy"))


@query("scalar_suite", f"SELECT (SELECT count(*) FROM members) AS members, (SELECT CAST(sum(length(role)) AS BIGINT) FROM members) AS role_chars, (SELECT count(*) FROM way_nodes) AS vertices, (SELECT CAST(sum(len(map_keys(tags))) AS BIGINT) FROM features) AS tags, (SELECT CAST(sum(list_sum(list_transform(map_keys(tags), lambda k: length(k)))) AS BIGINT) FROM features) AS key_chars")
def scalar_suite(f: Features) -> DataFrame:
    one_ = lambda df, *aggs: df.agg(*aggs).withColumn("k", F.lit(1))
    m = one_(f.lib.members, F.count("*").alias("members"), F.sum(F.length("role")).alias("role_chars"))
    v = one_(f.lib.way_nodes, F.count("*").alias("vertices"))
    chars = F.aggregate(F.map_keys("tags"), F.lit(0), lambda s, k: s + F.length(k))
    t = one_(f.df, F.sum(tags.tag_count()).alias("tags"), F.sum(chars).alias("key_chars"))
    return m.join(v, "k").join(t, "k").drop("k")


_M = EARTH_CIRCUMFERENCE / MAP_WIDTH
_C = 2 * math.pi / MAP_WIDTH
_SEG = f"sqrt(CAST(nx - sx AS DOUBLE) * CAST(nx - sx AS DOUBLE) + CAST(ny - sy AS DOUBLE) * CAST(ny - sy AS DOUBLE)) * ({_M!r} / cosh((CAST(sy AS DOUBLE) + ny) / 2 * {_C!r}))"


@query("way_length", f"SELECT way_id AS id, round(sum({_SEG}), 2) AS meters FROM segments GROUP BY 1", o.SEGMENTS)
def way_length(f: Features) -> DataFrame:
    return f.ways().lengths().select(F.expr("typed_id div 4").alias("id"), F.round("length", 2).alias("meters"))


@query("total_length", f"SELECT round(sum({_SEG}) / 1e6, 3) AS megameters FROM segments", o.SEGMENTS)
def total_length(f: Features) -> DataFrame:
    return f.ways().lengths().agg(F.round(F.sum("length") / 1e6, 3).alias("megameters"))


_AREA = f"4.78601e17 * ({_M!r} / cosh((CAST(min_y AS DOUBLE) + max_y) / 2 * {_C!r})) * ({_M!r} / cosh((CAST(min_y AS DOUBLE) + max_y) / 2 * {_C!r}))"


@query("way_area", f"SELECT id, round({_AREA} / 1e6, 2) AS km2 FROM areas")
def way_area(f: Features) -> DataFrame:
    return f.ways("a").areas().select(F.expr("typed_id div 4").alias("id"), F.round(F.col("area") / 1e6, 2).alias("km2"))


@query("total_area", f"SELECT round(sum({_AREA}) / 1e12, 3) AS mm2 FROM areas")
def total_area(f: Features) -> DataFrame:
    return f.ways().areas().agg(F.round(F.sum("area") / 1e12, 3).alias("mm2"))


@query("relation_area", f"SELECT id, round(4.78601e17 * ({_M!r} / cosh((CAST(min_y AS DOUBLE) + max_y) / 2 * {_C!r})) * ({_M!r} / cosh((CAST(min_y AS DOUBLE) + max_y) / 2 * {_C!r})) / 1e6, 2) AS km2 FROM nations")
def relation_area(f: Features) -> DataFrame:
    return f.relations("a").areas().select(F.expr("typed_id div 4").alias("id"), F.round(F.col("area") / 1e6, 2).alias("km2"))


@query("relation_length", "SELECT m.rel_id AS id, round(sum(" + _SEG + "), 2) AS meters FROM members m JOIN segments ON m_type = 1 AND way_id = m_id GROUP BY 1", o.SEGMENTS)
def relation_length(f: Features) -> DataFrame:
    return f.relations("a").lengths().select(F.expr("typed_id div 4").alias("id"), F.round("length", 2).alias("meters"))


@query("centroid_area", "SELECT id, round((min_x + max_x) / 2.0, 1) AS cx, round((min_y + max_y) / 2.0, 1) AS cy FROM areas")
def centroid_area(f: Features) -> DataFrame:
    return f.ways("a").centroids().select(F.expr("typed_id div 4").alias("id"), F.round("cx", 1).alias("cx"), F.round("cy", 1).alias("cy"))


_N = "sqrt(CAST(nx - sx AS DOUBLE) * CAST(nx - sx AS DOUBLE) + CAST(ny - sy AS DOUBLE) * CAST(ny - sy AS DOUBLE))"


@query("centroid_line", f"SELECT way_id AS id, CASE WHEN sum({_N}) > 0 THEN round(sum({_N} * (CAST(sx AS DOUBLE) + nx) / 2) / sum({_N}), 0) ELSE CAST(min(sx) AS DOUBLE) END AS cx, CASE WHEN sum({_N}) > 0 THEN round(sum({_N} * (CAST(sy AS DOUBLE) + ny) / 2) / sum({_N}), 0) ELSE CAST(min(sy) AS DOUBLE) END AS cy FROM segments WHERE way_id < 1000000 GROUP BY 1", o.SEGMENTS)
def centroid_line(f: Features) -> DataFrame:
    return f.ways("w").centroids().select(F.expr("typed_id div 4").alias("id"), F.round("cx", 0).alias("cx"), F.round("cy", 0).alias("cy"))


@query("centroid_relation", "SELECT id - " + str(NATIONS) + " AS id, round((min_x + max_x) / 2.0, 0) AS cx, round((min_y + max_y) / 2.0, 0) AS cy FROM areas")
def centroid_relation(f: Features) -> DataFrame:
    return f.relations("a").centroids().select(F.expr("typed_id div 4").alias("id"), F.round("cx", 0).alias("cx"), F.round("cy", 0).alias("cy"))


# scalars

_LON = f"(CAST(min_x AS DOUBLE) * 360.0 / {MAP_WIDTH!r})"
_LAT = f"(atan(exp(CAST(min_y AS DOUBLE) * {_C!r})) * 360.0 / {math.pi!r} - 90.0)"


@query("xy_lonlat", f"SELECT id, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM features WHERE type = 0 AND is_member")
def xy_lonlat(f: Features) -> DataFrame:
    rows = f.nodes().df.where("is_member")
    return rows.select("id", F.round(mercator.lon_from_x(F.col("min_x")), 6).alias("lon"), F.round(mercator.lat_from_y(F.col("min_y")), 6).alias("lat"))


@query("mercator_round_trip", "SELECT id, min_x AS x, min_y AS y FROM features WHERE type = 0 AND is_member")
def mercator_round_trip(f: Features) -> DataFrame:
    lon, lat = mercator.lon_from_x(F.col("min_x")), mercator.lat_from_y(F.col("min_y"))
    return f.nodes().df.where("is_member").select("id", mercator.x_from_lon(lon).cast("long").alias("x"), mercator.y_from_lat(lat).cast("long").alias("y"))


@query("bounds", "SELECT id, CAST(trunc((min_x + max_x) / 2.0) AS BIGINT) AS x, CAST(trunc((min_y + max_y) / 2.0) AS BIGINT) AS y FROM features WHERE type = 1")
def bounds(f: Features) -> DataFrame:
    return f.ways().df.select("id", measures.middle(F.col("min_x"), F.col("max_x")).alias("x"), measures.middle(F.col("min_y"), F.col("max_y")).alias("y"))


@query("tile_of", "SELECT id, CAST((CAST(min_x AS BIGINT) + 2147483648) >> 20 AS INT) AS col, CAST((2147483647 - CAST(max_y AS BIGINT)) >> 20 AS INT) AS row FROM features WHERE type = 1")
def tile_of(f: Features) -> DataFrame:
    return f.ways().df.select("id", boxes.column_from_x(F.col("min_x"), 12).alias("col"), boxes.row_from_y(F.col("max_y"), 12).alias("row"))


@query("tag_lookup", "SELECT id, coalesce(tags['mktsegment'], '') AS segment FROM features WHERE type = 0 AND is_member")
def tag_lookup(f: Features) -> DataFrame:
    return f.nodes().df.where("is_member").select("id", tags.value("mktsegment").alias("segment"))


@query("has_tag_kv", select_ids("coalesce(tags['status'] = 'P', false) OR tags['supplier'] IS NOT NULL"))
def has_tag_kv(f: Features) -> DataFrame:
    return ids(f.filter(tags.has_tag("status", "P") | tags.has_tag("supplier")))


@query("tag_explode", "SELECT t.k AS key, count(*) AS n FROM (SELECT unnest(map_keys(tags)) AS k FROM features) t GROUP BY 1")
def tag_explode(f: Features) -> DataFrame:
    return f.df.select(F.explode(F.map_keys("tags")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query("tag_values", f"SELECT id, coalesce({o.number("tags['size']")}, 0.0) AS as_double, CAST(trunc(coalesce({o.number("tags['size']")}, 0.0)) AS BIGINT) AS as_long, length(tags['size']) AS chars FROM features WHERE tags['size'] IS NOT NULL")
def tag_values(f: Features) -> DataFrame:
    v = tags.tag("size")
    return f.df.where(v.isNotNull()).select("id", tags.to_double(v).alias("as_double"), tags.to_long(v).alias("as_long"), F.char_length(v).cast("long").alias("chars"))


@query("truthy", f"SELECT id FROM features WHERE coalesce(tags['mktsegment'] NOT IN ('', 'no'), false)")
def truthy(f: Features) -> DataFrame:
    return f.filter(tags.truthy(tags.tag("mktsegment"))).df.select("id")


@query("label", "SELECT id, CASE WHEN tags['name'] IS NULL THEN w ELSE w || ' \"' || tags['name'] || '\"' END AS label FROM (SELECT id, tags, CASE WHEN k IS NULL THEN 'feature' WHEN tags[k] = 'yes' THEN k ELSE tags[k] END AS w FROM (SELECT id, tags, list_filter(list_sort(map_keys(tags)), lambda x: tags[x] NOT IN ('', 'no', '0.00'))[1] AS k FROM features))")
def label(f: Features) -> DataFrame:
    return f.df.select("id", tags.label().alias("label"))


@query("feature_string", "SELECT id, ['node', 'way', 'relation'][type + 1] || '/' || id AS name FROM features")
def feature_string(f: Features) -> DataFrame:
    return f.df.select("id", tags.feature_string().alias("name"))


# output


def _text(v: str, places: int = 6) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST(round({v}, {places}) AS DECIMAL(30, {places})) AS VARCHAR), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '')"


@query("rows_projection", f"SELECT 'N' || id AS id, {_text(_LON)} AS lon, {_text(_LAT)} AS lat, coalesce(tags['mktsegment'], '') AS mktsegment, coalesce(tags['name'], '') AS name FROM features WHERE type = 0 AND is_member")
def rows_projection(f: Features) -> DataFrame:
    return f.nodes().filter(F.col("is_member")).rows("id,lon,lat,mktsegment,name", 6)


_VLON = f"(CAST(x AS DOUBLE) * 360.0 / {MAP_WIDTH!r})"
_VLAT = f"(atan(exp(CAST(y AS DOUBLE) * {_C!r})) * 360.0 / {math.pi!r} - 90.0)"


@query("wkt_way", f"SELECT way_id AS id, CASE WHEN way_id > {NATIONS - 1} THEN 'POLYGON((' || t || '))' ELSE 'LINESTRING(' || t || ')' END AS wkt FROM (SELECT way_id, string_agg({_text(_VLON)} || ' ' || {_text(_VLAT)}, ',' ORDER BY seq) AS t FROM way_nodes GROUP BY 1)")
def wkt_way(f: Features) -> DataFrame:
    return f.ways().geometries("wkt", 6).select(F.expr("typed_id div 4").alias("id"), F.col("geometry").alias("wkt"))


def _json(v: str) -> str:
    """A JSON value in SQL: numbers bare, texts quoted."""
    return f"CASE WHEN {o.stored(v)} THEN {v} ELSE CAST(to_json({v}) AS VARCHAR) END"


def _properties(tags_: str, without: str = "") -> str:
    return f"'{{' || array_to_string(list_transform(list_sort(list_filter(map_keys({tags_}), lambda x: x <> '{without}')), lambda k: CAST(to_json(k) AS VARCHAR) || ':' || {_json(f'{tags_}[k]')}), ',') || '}}'"


_JSON_RING = f"string_agg('[' || {_text('@LON', 7)} || ',' || {_text('@LAT', 7)} || ']', ',' ORDER BY seq)"


@query("geojson_way", f"""SELECT typed_id, '{{"type":"Feature","id":"W' || id || '","geometry":{{"type":"' || CASE WHEN is_area THEN 'Polygon","coordinates":[[' || t || ']]' ELSE 'LineString","coordinates":[' || t || ']' END || '}},"properties":' || {_properties('tags')} || '}}' AS geojson
FROM (SELECT id, id * 4 + 1 AS typed_id, is_area, tags FROM features WHERE type = 1) JOIN (SELECT way_id, {_JSON_RING.replace('@LON', _VLON).replace('@LAT', _VLAT)} AS t FROM way_nodes GROUP BY 1) ON way_id = id""")
def geojson_way(f: Features) -> DataFrame:
    return f.ways().geojson()


_RING_OF = f"""ring AS (SELECT m.rel_id AS id, {_JSON_RING.replace('seq)', 'w.seq)').replace('@LON', _VLON).replace('@LAT', _VLAT)} AS t FROM members m JOIN way_nodes w ON m.m_type = 1 AND w.way_id = m.m_id GROUP BY 1)"""


@query("geojson_relation", f"""SELECT f.id * 4 + 2 AS typed_id, '{{"type":"Feature","id":"R' || f.id || '","geometry":{{"type":"Polygon","coordinates":[[' || t || ']]}},"properties":' || {_properties('f.tags')} || '}}' AS geojson
FROM features f JOIN ring ON ring.id = f.id WHERE f.type = 2 AND f.is_area""", _RING_OF)
def geojson_relation(f: Features) -> DataFrame:
    return f.relations("a").geojson()


@query("geojson_collection_relation")
def geojson_collection_relation(f: Features) -> DataFrame:
    return f.relations("r").geojson()


def _csv(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '[\",\r\n]') THEN '\"' || replace({v}, '\"', '\"\"') || '\"' ELSE {v} END"


_CLON = f"(((CAST(a.min_x AS DOUBLE) + a.max_x) / 2) * 360.0 / {MAP_WIDTH!r})"
_CLAT = f"(atan(exp(((CAST(a.min_y AS DOUBLE) + a.max_y) / 2) * {_C!r})) * 360.0 / {math.pi!r} - 90.0)"
_WKT_RING = f"string_agg({_text(_VLON)} || ' ' || {_text(_VLAT)}, ',' ORDER BY w.seq)"


@query("csv_rows", f"""SELECT 'R' || f.id || ',' || {_text(_CLON)} || ',' || {_text(_CLAT)} || ',' || {_csv("f.tags['name']")} || ',' || {_csv(_properties('f.tags', 'name'))} || ',' || {_csv("'POLYGON((' || t || '))'")} AS value
FROM features f JOIN areas a ON a.id = f.id + {NATIONS} JOIN (SELECT m.rel_id AS id, {_WKT_RING} AS t FROM members m JOIN way_nodes w ON m.m_type = 1 AND w.way_id = m.m_id GROUP BY 1) r ON r.id = f.id WHERE f.type = 2 AND f.is_area""")
def csv_rows(f: Features) -> DataFrame:
    return formats.csv_lines(f.relations("a").rows("id,lon,lat,name,tags,geom", 6))


@query("leaflet")
def leaflet(f: Features) -> DataFrame:
    page = f.ways("a").map_html(title="Nations")
    return f.lib.spark.createDataFrame([(page,)], "html string")


@query("library_info", "SELECT count(*) AS features, CAST(sum(CASE WHEN type = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nodes, CAST(sum(CASE WHEN type = 1 THEN 1 ELSE 0 END) AS BIGINT) AS ways, CAST(sum(CASE WHEN type = 2 THEN 1 ELSE 0 END) AS BIGINT) AS relations FROM features")
def library_info(f: Features) -> DataFrame:
    return f.lib.info().select("features", "nodes", "ways", "relations")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one segment in each nation's area."""
    f = world(spark, sf_dir)
    found = points_in_polygons(f("n[mktsegment=BUILDING]").df.select("id", "min_x", "min_y"), area_polygons(f))
    return found.groupBy("polygon").agg(F.count("*").alias("n"))


def queries() -> dict:
    return dict(_QUERIES)


def on_world() -> dict:
    """Name -> callable(Features), for a library that is open already."""
    return dict(_ON_WORLD)


def oracle_sql() -> dict:
    return dict(_SQL)
