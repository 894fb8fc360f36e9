"""Vertices, members and parents of features, as joins of whole sets; a single feature is a set of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.library import Library, nested


def vertices(lib: Library, ways: DataFrame) -> DataFrame:
    """(way_id, seq, node_id, x, y) of ways (id), in order by seq; areas end with their first vertex."""
    return lib.way_nodes.join(ways.where("type = 1").select(F.col("id").alias("way_id")).distinct(), "way_id", "left_semi")


def way_nodes(lib: Library, ways: DataFrame, only_features: bool = False) -> DataFrame:
    """Node rows with way_id and seq. Vertices without a feature are anonymous: null typed_id, no tags."""
    v = vertices(lib, ways).withColumn("typed_id", F.col("node_id") * 4)
    nodes = lib.features.where("type = 0")
    plain = [c for c in nodes.columns if c not in ("typed_id",)]
    if only_features:
        return v.select("way_id", "seq", "typed_id").join(nodes, "typed_id").select("way_id", "seq", *nodes.columns)
    found = v.join(nodes.select("typed_id", *[F.col(c).alias(f"f_{c}") for c in plain]), "typed_id", "left")
    own = {"id": F.coalesce("node_id", F.lit(0)), "min_x": F.col("x"), "min_y": F.col("y"), "max_x": F.col("x"), "max_y": F.col("y"), "type": F.lit(0).cast("tinyint"),
           "is_area": F.lit(False), "is_member": F.lit(False), "is_waynode": F.lit(True), "key_bits": F.lit(0), "tags": F.create_map().cast("map<string,string>")}
    known = F.col("f_id").isNotNull()
    made = {c: F.coalesce(F.col(f"f_{c}"), own[c]) if c in own else F.col(f"f_{c}") for c in plain}
    made["typed_id"] = F.when(known, F.col("typed_id"))
    return found.select("way_id", "seq", *[made[c].alias(c) for c in nodes.columns])


def members(lib: Library, relations: DataFrame) -> DataFrame:
    """Feature rows of the members of relations, with rel_id, seq and role. Members that the library lacks are left out."""
    m = lib.members.join(relations.where("type = 2").select(F.col("id").alias("rel_id")).distinct(), "rel_id", "left_semi")
    m = m.select("rel_id", "seq", "role", F.col("m_typed_id").alias("typed_id"))
    return m.join(lib.features, "typed_id").select("rel_id", "seq", "role", *lib.features.columns)


def parent_ways(lib: Library, nodes: DataFrame) -> DataFrame:
    """Ways that have one of the nodes as a vertex, with the node's typed_id as child; once per child.

    Nodes are found by id; anonymous ones, without typed_id, by their place.
    """
    known = nodes.where("type = 0 AND typed_id IS NOT NULL").select(F.col("id").alias("node_id"), F.col("typed_id").alias("child")).distinct()
    found = lib.way_nodes.join(known, "node_id").select("child", "way_id")
    if "typed_id" in nodes.columns and dict(nodes.dtypes)["typed_id"] == "bigint":
        bare = nodes.where("type = 0 AND typed_id IS NULL").select(F.col("min_x").alias("x"), F.col("min_y").alias("y")).distinct()
        found = found.union(lib.way_nodes.join(bare, ["x", "y"]).select(F.lit(None).cast("bigint"), "way_id"))
    ways = lib.features.where("type = 1")
    return found.distinct().join(ways, F.col("way_id") == F.col("id")).select("child", *ways.columns)


def parent_relations(lib: Library, children: DataFrame) -> DataFrame:
    """Relations with one of the features as a member, with its typed_id as child; once per child."""
    of = children.select(F.col("typed_id").alias("m_typed_id")).distinct()
    found = lib.members.join(of, "m_typed_id").select(F.col("m_typed_id").alias("child"), "rel_id").distinct()
    rels = lib.features.where("type = 2")
    return found.join(rels, F.col("rel_id") == F.col("id")).select("child", *rels.columns)


def parents(lib: Library, children: DataFrame) -> DataFrame:
    return parent_ways(lib, children).unionByName(parent_relations(lib, children))


def closure(lib: Library, relations: DataFrame) -> DataFrame:
    """(root, m_typed_id, m_type, m_id) of all members of relations, also of relations in them, each once a root.

    Cycles end as a relation is expanded once a root.
    """
    roots = relations.where("type = 2").select(F.col("id").alias("root"), F.col("id").alias("rel_id")).distinct()
    direct = lib.members.select("rel_id", "m_typed_id", "m_type", "m_id")
    return nested(roots, lib.members).join(direct, "rel_id").select("root", "m_typed_id", "m_type", "m_id").distinct()


def connected(lib: Library, features: DataFrame, to: DataFrame) -> DataFrame:
    """Features that share a vertex's place with one of ``to`` and aren't among them; relations by all their members."""
    mine, theirs = places(lib, features), places(lib, to)
    found = mine.join(theirs.select("x", "y").distinct(), ["x", "y"], "left_semi").select("typed_id").distinct()
    return features.join(found, "typed_id", "left_semi").join(to.select("typed_id"), "typed_id", "left_anti")


def places(lib: Library, features: DataFrame) -> DataFrame:
    """(typed_id, x, y) of nodes, vertices of ways, and both of relations' members."""
    flat = features.where("type < 2").select("typed_id", F.col("typed_id").alias("part"))
    deep = closure(lib, features.select("type", "id")).where("m_type < 2").select((F.col("root") * 4 + 2).alias("typed_id"), F.col("m_typed_id").alias("part"))
    parts = flat.union(deep)
    nodes = lib.features.where("type = 0").select(F.col("typed_id").alias("part"), F.col("min_x").alias("x"), F.col("min_y").alias("y"))
    lines = lib.way_nodes.select((F.col("way_id") * 4 + 1).alias("part"), "x", "y")
    return parts.join(nodes.union(lines), "part").select("typed_id", "x", "y").distinct()
