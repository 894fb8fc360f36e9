"""A tiny town with every kind of feature, as a library."""

from pyspark.sql import functions as F

from terrafold.operators.features import Features
from terrafold.sources.library import derive

TAGS = "map<string,string>"
NODES = {
    1: (10, 10, {"amenity": "pub", "name": "Crown", "stars": "4"}), 2: (0, 50, {"amenity": "bench"}), 3: (200, 200, {"shop": "no"}),
    4: (10, 10, {"amenity": "cafe", "4wd": "yes"}), 10: (0, 0, {}), 11: (100, 0, {}), 12: (100, 100, {}), 13: (0, 100, {"barrier": "gate"}),
    20: (-50, 50, {}), 21: (50, 50, {}), 22: (150, 50, {}), 30: (40, 40, {}), 31: (60, 40, {}), 32: (60, 60, {}), 33: (40, 60, {}),
    40: (50, 20, {"place": "label"}), 50: (300, 300, {}),
}
WAYS = {
    100: ([10, 11, 12, 13, 10], {"leisure": "park", "name": "Green"}), 101: ([20, 21, 22], {"highway": "primary", "maxspeed": "50 mph", "lanes": "2"}),
    102: ([30, 31, 32, 33, 30], {"junction": "roundabout", "highway": "service", "area": "no"}), 103: ([10, 11, 12], {}), 104: ([12, 13, 10], {}),
    105: ([22, 50], {"highway": "track", "surface": ""}),
}
RELATIONS = {
    1000: ([(1, 103, "outer"), (1, 104, "outer"), (1, 102, "inner"), (0, 40, "label")], {"type": "multipolygon", "landuse": "grass"}),
    1001: ([(1, 101, "forward"), (0, 2, "stop"), (1, 105, None)], {"type": "route", "route": "bus"}),
    1002: ([(2, 1001, ""), (2, 1003, "")], {"type": "network"}), 1003: ([(2, 1002, ""), (0, 3, "end")], {"type": "network"}),
}


def library(spark):
    nodes = spark.createDataFrame([(k, x, y, t) for k, (x, y, t) in NODES.items()], f"id long, x int, y int, tags {TAGS}")
    ways = spark.createDataFrame([(k, t) for k, (_, t) in WAYS.items()], f"id long, tags {TAGS}")
    relations = spark.createDataFrame([(k, t) for k, (_, t) in RELATIONS.items()], f"id long, tags {TAGS}")
    vertices = [(k, n, v, *NODES[v][:2]) for k, (vs, _) in WAYS.items() for n, v in enumerate(vs)]
    members = [(k, n, *m) for k, (ms, _) in RELATIONS.items() for n, m in enumerate(ms)]
    return derive(nodes, ways, relations, spark.createDataFrame(vertices, "way_id long, seq int, node_id long, x int, y int"),
                  spark.createDataFrame(members, "rel_id long, seq int, m_type int, m_id long, role string"))


def library_of(spark, areas, nodes):
    """Closed ways given by vertices, which are no nodes, and nodes."""
    n = spark.createDataFrame([(k, *v) for k, v in nodes.items()], f"id long, x int, y int, tags {TAGS}")
    ways = spark.createDataFrame([(k, {"area": "yes"}) for k in areas], f"id long, tags {TAGS}")
    vertices = [(k, i, 1000 * k + i, x, y) for k, ring in areas.items() for i, (x, y) in enumerate(ring)]
    none = spark.createDataFrame([], f"id long, tags {TAGS}")
    members = spark.createDataFrame([], "rel_id long, seq int, m_type int, m_id long, role string")
    return Features.of(derive(n, ways, none, spark.createDataFrame(vertices, "way_id long, seq int, node_id long, x int, y int"), members))


def town(spark):
    lib = library(spark)
    kept = {n: getattr(lib, n).cache() for n in ("features", "way_nodes", "members")}
    from dataclasses import replace

    return Features.of(replace(lib, **kept))


def ids(features):
    return sorted(r.id for r in features.df.select(F.col("id")).collect())
