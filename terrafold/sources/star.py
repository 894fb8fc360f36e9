"""The star-schema tables as a library: customers, suppliers and parts are nodes, orders ways, nations areas and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .library import Library, cell, key_bits, typed_id

INDEXED = ("mktsegment", "supplier", "brand", "priority", "boundary", "name")
SUPPLIERS, PARTS, NATIONS, REGIONS = 1_000_000_000, 2_000_000_000, 3_000_000_000, 100
TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def x_of(k: Column) -> Column:
    return (((k * 7919 + 17) % 4000) * 1000000 - 2000000000).cast("int")


def y_of(k: Column) -> Column:
    return (((k * 104729 + 31) % 3000) * 1000000 - 1500000000).cast("int")


def tag_map(**tags: Column) -> Column:
    """A map of the tags that aren't null."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def corners(nation: Column) -> list[tuple[Column, Column]]:
    """Of a nation's rectangle in a grid of five by five, counter-clockwise from the south-west, closed."""
    west = (nation % 5) * 800000000 - 2000000000
    south = F.floor(nation / 5) * 600000000 - 1500000000
    east, north = west + 799000000, south + 599000000
    return [(west, south), (east, south), (east, north), (west, north), (west, south)]


def open_star(spark: SparkSession, path: str) -> Library:
    """A lazy library over the tables: nothing is copied, and what a query doesn't need isn't computed."""
    t = lambda name: spark.read.parquet(f"{path}/{name}.parquet")
    false, true = F.lit(False), F.lit(True)
    box = ["min_x", "min_y", "max_x", "max_y"]

    def node(df: DataFrame, number: Column, tags: Column, member: bool, waynode: Column) -> DataFrame:
        x, y = x_of(F.col("id")), y_of(F.col("id"))
        return df.withColumn("id", number.cast("bigint")).select(
            F.lit(0).cast("tinyint").alias("type"), "id", false.alias("is_area"), F.lit(member).alias("is_member"), waynode.alias("is_waynode"),
            *[c.alias(n) for c, n in zip((x, y, x, y), box, strict=True)], tags.alias("tags"),
        )

    c = t("customer")
    segment = F.when(F.col("c_custkey") % 7 == 0, "no").when(F.col("c_custkey") % 11 == 0, None).otherwise(F.col("c_mktsegment"))
    money = lambda col: F.col(col).cast("decimal(15,2)").cast("string")
    customers = node(c, F.col("c_custkey"), tag_map(mktsegment=segment, name=F.col("c_name"), acctbal=money("c_acctbal")), True, false)
    suppliers = node(t("supplier"), F.col("s_suppkey") + SUPPLIERS, tag_map(name=F.col("s_name"), acctbal=money("s_acctbal"), supplier=F.lit("yes")), True, false)
    size = (
        F.when(F.col("p_partkey") % 13 == 0, "n/a").when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" mm")))
        .otherwise(F.col("p_size").cast("string"))
    )
    lines = t("lineitem")
    long_orders = lines.groupBy("l_orderkey").agg(F.count("*").alias("n")).where("n > 1").select("l_orderkey")
    kept = lines.join(long_orders, "l_orderkey", "left_semi")
    # a part is a vertex if an order of two lines or more has it
    on_ways = kept.select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("on_way", true)
    part = t("part").where("p_partkey % 3 = 0").join(on_ways, "p_partkey", "left")
    parts = node(part, F.col("p_partkey") + PARTS, tag_map(brand=F.col("p_brand"), type=F.col("p_type"), size=size), False, F.coalesce("on_way", false))

    vertex = F.col("l_partkey") + PARTS
    bounds = lines.withColumn("x", x_of(vertex)).withColumn("y", y_of(vertex)).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.bool_or(F.col("l_partkey") % 3 == 0).alias("is_waynode"), F.count("*").alias("n"),
        # read only where vertices are: the plan drops it elsewhere
        F.transform(F.array_sort(F.collect_list(F.struct(*TIES.split(", "), "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"),
    ).where("n > 1")
    ways = t("orders").join(bounds, "o_orderkey").select(
        F.lit(1).cast("tinyint").alias("type"), F.col("o_orderkey").cast("bigint").alias("id"), false.alias("is_area"), false.alias("is_member"), "is_waynode", *box,
        tag_map(priority=F.col("o_orderpriority"), status=F.col("o_orderstatus")).alias("tags"), "points",
    )
    n = t("nation")
    key = F.col("n_nationkey").cast("bigint")
    (west, south), _, (east, north), *_ = corners(key)
    rectangle = [v.cast("int").alias(b) for v, b in zip((west, south, east, north), box, strict=True)]
    areas = n.select(
        F.lit(1).cast("tinyint").alias("type"), (key + NATIONS).alias("id"), true.alias("is_area"), true.alias("is_member"), false.alias("is_waynode"), *rectangle,
        tag_map(boundary=F.lit("administrative"), admin_level=F.lit("2"), name=F.col("n_name")).alias("tags"),
        F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in corners(key)]).alias("points"),
    )
    people = c.select(F.col("c_nationkey").alias("k"), F.lit(0).alias("part"), F.col("c_custkey").cast("bigint").alias("m_id"), F.lower("c_mktsegment").alias("role"))
    sellers = t("supplier").select(F.col("s_nationkey").alias("k"), F.lit(1).alias("part"), (F.col("s_suppkey") + SUPPLIERS).alias("m_id"), F.lit("supplier").alias("role"))
    frames = n.select(F.col("n_nationkey").alias("k"), F.lit(2).alias("part"), (key + NATIONS).alias("m_id"), F.lit("outer").alias("role"))
    inside = people.union(sellers).union(frames)
    # a nation's members in order: a nation may hold a large share of customers, so positions are ids in kind, not a global row number
    seq = (F.col("part") * 1_000_000_000 + F.col("m_id") % 1_000_000_000).cast("int")
    of_nations = inside.select(F.col("k").cast("bigint").alias("rel_id"), seq.alias("seq"), F.when(F.col("part") == 2, 1).otherwise(0).cast("tinyint").alias("m_type"), "m_id", "role")
    of_regions = n.select((F.col("n_regionkey") + REGIONS).cast("bigint").alias("rel_id"), F.col("n_nationkey").alias("seq"), F.lit(2).cast("tinyint").alias("m_type"), key.alias("m_id"), F.lit("nation").alias("role"))
    members = of_nations.unionByName(of_regions).select("rel_id", "seq", "m_type", "m_id", typed_id(F.col("m_type"), F.col("m_id")).alias("m_typed_id"), "role")
    node_box = inside.where("part < 2").groupBy("k").agg(*[fn(g(F.col("m_id"))).alias(b) for fn, g, b in ((F.min, x_of, "bx1"), (F.min, y_of, "by1"), (F.max, x_of, "bx2"), (F.max, y_of, "by2"))])
    joined = n.join(node_box, F.col("n_nationkey") == F.col("k"), "left")
    least = [fn(v.cast("int"), F.col(b)) for fn, v, b in ((F.least, west, "bx1"), (F.least, south, "by1"), (F.greatest, east, "bx2"), (F.greatest, north, "by2"))]
    nations = joined.select(
        F.lit(2).cast("tinyint").alias("type"), key.alias("id"), true.alias("is_area"), true.alias("is_member"), false.alias("is_waynode"),
        *[c_.alias(b) for c_, b in zip(least, box, strict=True)], tag_map(type=F.lit("boundary"), name=F.col("n_name")).alias("tags"), "n_regionkey",
    )
    union = [fn(b).alias(b) for fn, b in zip((F.min, F.min, F.max, F.max), box, strict=True)]
    regions = t("region").join(nations.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(*union), "r_regionkey", "left").select(
        F.lit(2).cast("tinyint").alias("type"), (F.col("r_regionkey") + REGIONS).cast("bigint").alias("id"), false.alias("is_area"), false.alias("is_member"), false.alias("is_waynode"), *box,
        tag_map(type=F.lit("collection"), name=F.col("r_name")).alias("tags"),
    )
    rows = customers
    for df in (suppliers, parts, ways, areas, nations.drop("n_regionkey"), regions):
        rows = rows.unionByName(df, allowMissingColumns=True)
    features = rows.select("*", typed_id(F.col("type"), F.col("id")).alias("typed_id"), key_bits(F.col("tags"), INDEXED).alias("key_bits"), cell(F.col("min_x"), F.col("max_y")).alias("cell"))
    # the tie-break makes the order of vertices unique
    order = F.expr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {TIES})") - 1
    order_nodes = kept.select(F.col("l_orderkey").cast("bigint").alias("way_id"), order.cast("int").alias("seq"), vertex.cast("bigint").alias("node_id"))
    order_nodes = order_nodes.select("*", x_of(F.col("node_id")).alias("x"), y_of(F.col("node_id")).alias("y"))
    ring = F.posexplode(F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in corners(key)])).alias("seq", "p")
    frame_nodes = n.select((key + NATIONS).alias("way_id"), ring).select("way_id", F.col("seq").cast("int").alias("seq"), F.lit(None).cast("bigint").alias("node_id"), "p.x", "p.y")
    return Library(features, order_nodes.unionByName(frame_nodes), members, INDEXED)
