"""A library of features: three tables, read from Parquet or derived from nodes, ways and relations."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.box import cell, hilbert
from .scratch import discard, materialize

FEATURES = (
    "type tinyint, id bigint, typed_id bigint, is_area boolean, is_member boolean, is_waynode boolean, "
    "min_x int, min_y int, max_x int, max_y int, tags map<string,string>, key_bits int, cell int, points array<struct<x:int,y:int>>"
)
#: Columns that a library may lack.
OPTIONAL = ("points",)
WAY_NODES = "way_id bigint, seq int, node_id bigint, x int, y int"
MEMBERS = "rel_id bigint, seq int, m_type tinyint, m_id bigint, m_typed_id bigint, role string"
META = "indexed array<string>, revision bigint, timestamp string, guid string, properties map<string,string>, folder string"
TABLES = {"features": FEATURES, "way_nodes": WAY_NODES, "members": MEMBERS}
#: Keys with a bit in key_bits, 31 at most. A parameter of every library; these are the defaults.
INDEXED = ("amenity", "shop", "highway", "building", "railway", "landuse", "natural", "leisure", "tourism", "waterway", "power", "boundary", "place", "man_made", "route")
#: A closed way with one of these is an area unless tagged area=no.
AREA_KEYS = ("building", "landuse", "natural", "leisure", "amenity", "shop", "tourism", "boundary", "place", "man_made", "area:highway")


class LibraryError(ValueError):
    """A folder that isn't a library."""


def typed_id(kind: Column, number: Column) -> Column:
    return number * 4 + kind.cast("bigint")


def ordered_points() -> Column:
    """Aggregate of vertices (seq, x, y): an array of them in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def key_bits(tags: Column, indexed=INDEXED) -> Column:
    found = F.lit(0)
    for n, key in enumerate(indexed):
        found = found + F.when(F.map_contains_key(tags, key), 1 << n).otherwise(0)
    return F.coalesce(found, F.lit(0)).cast("int")


@dataclass(frozen=True)
class Library:
    """Lazy tables. features has a row a feature, way_nodes a row a vertex in order, members a row a member in order."""

    features: DataFrame
    way_nodes: DataFrame
    members: DataFrame
    indexed: tuple[str, ...] = INDEXED
    #: revision, timestamp (ISO 8601), guid and properties, as far as they're known.
    meta: dict = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.features.sparkSession

    @staticmethod
    def open(spark: SparkSession, path: str, indexed=None, revision: int | None = None) -> Library:
        """The library in a folder, with the indexed keys that it was written with; its last revision, or an earlier one.

        Missing tables, wrong columns and other indexed keys than the library's are errors before any query runs.
        """
        meta = revisions(spark, path).get(revision, {})
        if revision is not None and not meta:
            raise LibraryError(f"no revision {revision} in {path}")
        folder = meta.pop("folder", None)
        base = f"{path}/{folder}" if folder else path
        known = tuple(meta.pop("indexed", None) or indexed or INDEXED)
        if indexed is not None and tuple(indexed) != known:
            raise LibraryError(f"the library in {path} has other indexed keys: {', '.join(known)}")
        found = {}
        for name, ddl in TABLES.items():
            try:
                df = spark.read.parquet(f"{base}/{name}")
            except Exception as e:
                raise LibraryError(f"no table {name} in {path}") from e
            wanted = T._parse_datatype_string(ddl)
            kinds = {f.name: f.dataType for f in df.schema.fields}
            wrong = [f.name for f in wanted.fields if kinds.get(f.name, f.dataType if f.name in OPTIONAL else None) != f.dataType]
            if wrong:
                raise LibraryError(f"table {name} in {path} lacks {', '.join(wrong)}")
            found[name] = df
        return Library(**found, indexed=known, meta={k: v for k, v in meta.items() if v is not None})

    def write(self, path: str, files: int | None = None, **properties: str) -> None:
        """Clustered for pruning: features by tile along a Hilbert curve, vertices and members by owner.

        Files and row groups so hold compact parts of the map. A library that is there already gets a further
        revision in a folder of its own: tables are written first, the one file of metadata that makes them the
        library last, so readers see the old revision or the new one whole, and open sets go on reading theirs.
        """
        before = revisions(self.spark, path).get(None, {})
        revision = max(before.get("revision") or 0, self.meta.get("revision", 0)) + 1
        folder = f"revision-{revision}" if before else ""
        base = f"{path}/{folder}" if folder else path

        def dealt(df: DataFrame, *by: str) -> DataFrame:
            ranged = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
            return ranged.sortWithinPartitions(*by)

        tile = F.coalesce(F.col("cell"), F.lit(0)).bitwiseAND((1 << 24) - 1)
        placed = self.features.withColumn("_place", hilbert(tile % 4096, F.floor(tile / 4096)))
        dealt(placed, "_place", "type", "id").drop("_place").write.parquet(f"{base}/features")
        dealt(self.way_nodes, "way_id", "seq").write.parquet(f"{base}/way_nodes")
        dealt(self.members, "rel_id", "seq").write.parquet(f"{base}/members")
        now = datetime.now(timezone.utc).isoformat(timespec="seconds")
        all_ = {**(self.meta.get("properties") or {}), **properties}
        row = (list(self.indexed), revision, now, self.meta.get("guid") or before.get("guid") or str(uuid.uuid4()), all_, folder)
        self.spark.createDataFrame([row], META).coalesce(1).write.mode("append").json(f"{path}/meta")

    def tile(self, number: int) -> DataFrame:
        """Features of one tile (cell); a tile that the library lacks has none. The scan skips other tiles' row groups."""
        return self.features.where(F.col("cell") == number)

    def info(self) -> DataFrame:
        """One row: counts by type, tiles, bounds."""
        f = self.features
        return f.agg(
            F.count("*").alias("features"), *[F.count_if(F.col("type") == n).alias(k) for n, k in enumerate(("nodes", "ways", "relations"))],
            F.count_distinct("cell").alias("tiles"), *[fn(c).alias(c) for fn, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))],
        )

    def checksum(self) -> DataFrame:
        """A checksum per tile, independent of row order."""
        return self.features.groupBy("cell").agg(F.bit_xor(F.xxhash64(*[c for c in self.features.columns if c != "tags"], F.to_json("tags"))).alias("checksum"))

    def features_at(self, typed: DataFrame) -> DataFrame:
        return self.features.join(typed, "typed_id", "left_semi")


def revisions(spark: SparkSession, path: str) -> dict:
    """Metadata by revision, a row each; the last one also under None. Empty for folders without metadata."""
    try:
        rows = [r.asDict(recursive=True) for r in spark.read.schema(META).json(f"{path}/meta").collect()]
    except AnalysisException:
        return {}
    found = {r["revision"]: r for r in rows}
    return {**found, None: dict(found[max(found)])} if found else {}


def area_rule(tags: Column, closed: Column) -> Column:
    """Closed ways with area=yes, or an area key and not area=no."""
    keyed = F.lit(False)
    for k in AREA_KEYS:
        keyed = keyed | F.map_contains_key(tags, k)
    area = tags["area"]
    return F.coalesce(closed & (F.coalesce(area == "yes", F.lit(False)) | (keyed & (F.coalesce(area, F.lit("")) != "no"))), F.lit(False))


def nested(roots: DataFrame, members: DataFrame) -> DataFrame:
    """(root, rel_id) of roots and all relations in them, however deep.

    Links between relations are joined with themselves until no new pair appears: paths double with each round, so
    a nesting of n levels takes log n of them. Relations in relations are few beside other members.
    """
    reach = materialize(members.where("m_type = 2").select("rel_id", F.col("m_id").alias("sub")).distinct(), "nested")
    n = reach.count()
    while n:
        further = reach.join(reach.toDF("sub", "deeper"), "sub").select("rel_id", F.col("deeper").alias("sub"))
        grown = materialize(reach.union(further).distinct(), "nested")
        discard(reach)
        reach, before, n = grown, n, grown.count()
        if n == before:
            break
    return roots.union(roots.join(reach, "rel_id").select("root", F.col("sub").alias("rel_id"))).distinct()


def derive(nodes: DataFrame, ways: DataFrame, relations: DataFrame, way_nodes: DataFrame, members: DataFrame, indexed=INDEXED) -> Library:
    """A library from nodes (id, x, y, tags), ways (id, tags[, is_area]), relations (id, tags[, is_area]),
    way_nodes (way_id, seq, node_id, x, y) and members (rel_id, seq, m_type, m_id, role).

    Untagged nodes that are no members are anonymous: vertices only. Areas follow area_rule(), and relations
    of type multipolygon or boundary; an is_area column overrides. A relation's bounds are those of its
    members, of sub-relations at any depth.
    """
    members = members.select(
        "rel_id", F.col("seq").cast("int").alias("seq"), F.col("m_type").cast("tinyint").alias("m_type"), "m_id",
        typed_id(F.col("m_type"), F.col("m_id")).alias("m_typed_id"), F.coalesce("role", F.lit("")).alias("role"),
    )
    way_nodes = way_nodes.select("way_id", F.col("seq").cast("int").alias("seq"), "node_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    is_member = members.select(F.col("m_typed_id").alias("typed_id")).distinct().withColumn("is_member", F.lit(True))
    used = way_nodes.select(typed_id(F.lit(0), F.col("node_id")).alias("typed_id")).distinct().withColumn("is_waynode", F.lit(True))
    flat = lambda df, kind: df.withColumn("type", F.lit(kind).cast("tinyint")).withColumn("typed_id", typed_id(F.lit(kind), F.col("id")))
    false = lambda c: F.coalesce(c, F.lit(False))
    n = (
        flat(nodes, 0).join(is_member, "typed_id", "left").join(used, "typed_id", "left")
        .where((F.coalesce(F.size("tags"), F.lit(0)) > 0) | F.col("is_member").isNotNull() | F.col("is_waynode").isNull())
        .select("type", "id", "typed_id", F.lit(False).alias("is_area"), false(F.col("is_member")).alias("is_member"), false(F.col("is_waynode")).alias("is_waynode"),
                F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"), "tags")
    )
    feature_nodes = n.select("typed_id").withColumn("known", F.lit(True))
    extent = way_nodes.withColumn("typed_id", typed_id(F.lit(0), F.col("node_id"))).join(feature_nodes, "typed_id", "left").groupBy("way_id").agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.coalesce(F.bool_or("known"), F.lit(False)).alias("is_waynode"),
        (F.min_by(F.struct("x", "y"), "seq") == F.max_by(F.struct("x", "y"), "seq")).alias("closed"), F.count("*").alias("n"),
        ordered_points().alias("points"),
    )
    box = ["min_x", "min_y", "max_x", "max_y"]
    w = flat(ways, 1).join(extent.withColumnRenamed("way_id", "id"), "id").join(is_member, "typed_id", "left")
    w = w.select("type", "id", "typed_id", (F.col("is_area") if "is_area" in ways.columns else area_rule(F.col("tags"), F.col("closed") & (F.col("n") > 3))).alias("is_area"),
                 false(F.col("is_member")).alias("is_member"), "is_waynode", *box, "tags", "points")
    union = [fn(c).alias(c) for fn, c in zip((F.min, F.min, F.max, F.max), box, strict=True)]
    known = n.select("typed_id", *box).union(w.select("typed_id", *box))
    own = members.join(known.withColumnRenamed("typed_id", "m_typed_id"), "m_typed_id").groupBy("rel_id").agg(*union)
    within = nested(relations.select(F.col("id").alias("root"), F.col("id").alias("rel_id")).distinct(), members).join(own, "rel_id")
    extents = within.groupBy("root").agg(*union).select(typed_id(F.lit(2), F.col("root")).alias("typed_id"), *box)
    kind = F.coalesce(F.col("tags")["type"].isin("multipolygon", "boundary"), F.lit(False))
    r = flat(relations, 2).join(extents, "typed_id", "left").join(is_member, "typed_id", "left").select(
        "type", "id", "typed_id", (F.col("is_area") if "is_area" in relations.columns else kind).alias("is_area"), false(F.col("is_member")).alias("is_member"),
        F.lit(False).alias("is_waynode"), *box, "tags")
    rows = n.unionByName(w, allowMissingColumns=True).unionByName(r, allowMissingColumns=True)
    features = rows.select("*", key_bits(F.col("tags"), indexed).alias("key_bits"), cell(F.col("min_x"), F.col("max_y")).alias("cell"))
    return Library(features, way_nodes, members, tuple(indexed))
