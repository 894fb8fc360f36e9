"""Import of XML map extracts with Spark's own XML source: each element kind is a row tag, files are split by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mercator import x_from_lon, y_from_lat
from .library import INDEXED, Library, derive

TAGS = "tag array<struct<_k: string, _v: string>>"


def rows(spark: SparkSession, path: str, kind: str, ddl: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", kind).schema(f"_id bigint, {ddl}, {TAGS}").load(path).where("_id IS NOT NULL")


def tags():
    pairs = F.transform(F.coalesce("tag", F.array()), lambda t: F.struct(t["_k"].alias("key"), F.coalesce(t["_v"], F.lit("")).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda t: t["key"].isNotNull()))


def read(spark: SparkSession, path: str, indexed=INDEXED) -> Library:
    """The library of the elements in one or more XML files. Vertices and members that the files lack are left out."""
    node = rows(spark, path, "node", "_lat double, _lon double").where("_lat IS NOT NULL AND _lon IS NOT NULL")
    way = rows(spark, path, "way", "nd array<struct<_ref: bigint>>")
    rel = rows(spark, path, "relation", "member array<struct<_type: string, _ref: bigint, _role: string>>")
    nodes = node.select(F.col("_id").alias("id"), x_from_lon(F.col("_lon")).alias("x"), y_from_lat(F.col("_lat")).alias("y"), tags().alias("tags"))
    refs = way.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("seq", "nd")).select("way_id", "seq", F.col("nd._ref").alias("node_id"))
    way_nodes = refs.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id")
    kinds = F.create_map(*[F.lit(v) for kv in (("node", 0), ("way", 1), ("relation", 2)) for v in kv])
    members = rel.select(F.col("_id").alias("rel_id"), F.posexplode("member").alias("seq", "m")).select(
        "rel_id", "seq", kinds[F.col("m._type")].alias("m_type"), F.col("m._ref").alias("m_id"), F.col("m._role").alias("role")
    )
    both = lambda df: df.select(F.col("_id").alias("id"), tags().alias("tags"))
    return derive(nodes, both(way), both(rel), way_nodes, members.where("m_type IS NOT NULL"), indexed)
