import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions.box import Box
from terrafold.operators import features
from terrafold.operators.features import Features, ResultError
from terrafold.operators.kernel import Shape
from terrafold.operators.spatial import UnsupportedGeometry
from terrafold.sources.library import Library, LibraryError
from terrafold.sources.star import open_star

from .town import ids, town

SQUARE = Shape.of("polygon", [np.asarray([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)])])


@pytest.fixture(scope="module")
def world(spark):
    return town(spark)


def test_selection(world):
    assert ids(world("n[amenity]")) == [1, 2, 4] and ids(world("n[shop]")) == [] and ids(world("n[4wd]")) == [4]
    assert ids(world("a")) == [100, 1000] and 100 not in ids(world("w")) and 100 in ids(world.ways())
    assert ids(world("w[maxspeed=50]")) == [101] and ids(world("w[maxspeed='50 mph']")) == [101] and ids(world("w[lanes='2']")) == []
    assert ids(world("w[surface]")) == [105] and ids(world("n[amenity][amenity!=pub]")) == [2, 4]
    assert ids(world(Box(5, 5, 20, 20)).nodes()) == [1, 4] and ids(world("n[amenity]") & world(Box(5, 5, 20, 20))) == [1, 4]
    assert world("n[amenity]").count() == 3 and world("n[none]").is_empty() and not world.empty()
    assert ids(world("n[amenity]").filter(F.col("id") > 1)) == [2, 4]
    assert ids(world("n[amenity]").filter(lambda pdf: pdf["id"] == 2)) == [2]


def test_terminals(world):
    assert world("n[amenity=pub]").one().id == 1
    for q in ("n[amenity]", "n[none]"):
        with pytest.raises(ResultError):
            world(q).one()
    route = world.relations("r[route]")
    assert [r.role for r in route.members()] == ["forward", "stop", ""] and route.members().first().id == 101


def test_relationships(world):
    park = world("a[leisure]")
    assert [(r.seq, r.id, r.typed_id is None) for r in park.way_nodes()] == [(0, 10, True), (1, 11, True), (2, 12, True), (3, 13, False), (4, 10, True)]
    assert ids(park.way_nodes("n[barrier]")) == [13]
    assert ids(world("r[route]").members().with_role("stop")) == [2] and ids(world.nodes().with_role("stop")) == []
    assert ids(world("n[barrier]").parents()) == [100, 104] and ids(world.ways("w[highway=primary]").parents("r[route=bus]")) == [1001]
    assert ids(world.nodes().members_of(world("r[route]"))) == [2] and ids(world.nodes().nodes_of(park)) == [13]
    assert ids(world("w[highway=track]").connected_to(world("w[highway=primary]"))) == [105]
    from terrafold.operators.related import closure

    got = {(r.root, r.m_id) for r in closure(world.lib, world("r[type=network]").df).collect()}
    assert {m for root, m in got if root == 1002} == {1001, 1003, 1002, 101, 2, 105, 3}


def test_space(world):
    assert ids(world.nodes("n[amenity]").within(SQUARE)) == [1, 4] and ids(world.nodes("n[amenity]").intersecting(SQUARE)) == [1, 2, 4]
    assert ids(world.ways("w[highway]").crossing(SQUARE)) == [101] and ids(world.ways().within(SQUARE)) == [100, 102]
    assert set(ids(world.ways().intersecting(world("a[leisure]")))) == {100, 101, 102, 103, 104}
    assert ids(world.relations("a").containing(50, 50)) == [] and ids(world.relations("a").containing(20, 20)) == [1000]
    assert ids(world.ways("a").containing(world("n[amenity=pub]"))) == [100]
    assert 1001 in ids(world.relations().intersecting(SQUARE)) and ids(world.relations("r[route]").within(SQUARE)) == []
    with pytest.raises(UnsupportedGeometry):
        world.nodes().within(Shape.of("line", [np.asarray([(0, 0), (1, 1)])]))
    with pytest.raises(UnsupportedGeometry):
        world.nodes().intersecting(world("r[route]"))
    concave = Shape.of("polygon", [np.asarray([(-60, 40), (-40, 40), (-40, 45), (140, 45), (140, 40), (160, 40), (160, 60), (-60, 60), (-60, 40)])])
    assert 101 in ids(world.ways("w").within(concave))
    meters = 40075016.68558 / 4294967294.9999
    assert ids(world.nodes("n[amenity]").max_meters_from(15 * meters, 10, 20)) == [1, 4]
    assert ids(world.ways("w[highway]").max_meters_from(5 * meters, 0, 48)) == [101]


def line(*points):
    return Shape.of("line", [np.asarray(points)])


def test_containing_tests_edges_too(spark):
    from terrafold.operators.kernel import distance, holds

    from .town import library_of

    u = [(0, 0), (90, 0), (90, 90), (60, 90), (60, 30), (30, 30), (30, 90), (0, 90), (0, 0)]
    ring = np.hstack([np.asarray(u)[:-1], np.asarray(u)[1:]])
    square = lambda a, b: Shape.of("polygon", [np.asarray([(a, a), (b, a), (b, b), (a, b), (a, a)])])
    for shape, held in (
        (line((10, 80), (80, 80)), False), (line((10, 80), (10, 10), (80, 10), (80, 80)), True), (line((30, 30), (60, 30)), True), (line((30, 90), (60, 90)), False),
        (line((20, 30), (70, 30)), True), (line((20, 31), (70, 31)), False), (square(5, 25), True), (square(5, 85), False), (square(-5, 25), False),
        (Shape.of("point", [np.asarray([(10, 10)]), np.asarray([(45, 60)])]), False),
    ):
        assert holds(ring, shape) == held, shape
    world = library_of(spark, {1: u}, {})
    assert ids(world.ways("a").containing(line((10, 80), (80, 80)))) == [] and ids(world.ways("a").containing(line((10, 80), (10, 10)))) == [1]
    assert distance(line((0, 0), (10, 0)), line((0, 5), (10, 7))) == 5 and distance(square(0, 100), square(40, 60)) == 0


def test_containing_in_relations_with_holes(world):
    rel = world.relations("a")
    assert ids(rel.containing(line((10, 10), (10, 90)))) == [1000] and ids(rel.containing(line((10, 50), (90, 50)))) == []
    around = Shape.of("polygon", [np.asarray([(20, 20), (80, 20), (80, 80), (20, 80), (20, 20)])])
    assert ids(rel.containing(around)) == [] and ids(world.ways("a").containing(around)) == [100]


def test_areas_on_the_boundary_are_within_by_their_centroid(spark):
    from .town import library_of

    notched = Shape.of("polygon", [np.asarray([(0, 0), (90, 0), (90, 90), (60, 90), (60, 30), (30, 30), (30, 90), (0, 90), (0, 0)])])
    # all vertices on the boundary; the second spans the notch with most of its area in it
    world = library_of(spark, {1: [(0, 0), (90, 0), (60, 30), (30, 30), (0, 0)], 2: [(30, 30), (60, 30), (60, 90), (30, 90), (30, 30)]}, {})
    assert ids(world.ways("a").within(notched)) == [1]


def test_membership_and_nodes_by_use(world, spark):
    pub = world("n[amenity=pub]")
    assert pub in world and pub.one() in world.nodes() and pub not in world.ways() and world("a[leisure]").one() in world("a")
    assert ids(world("n").sharing_location()) == [1, 4] and ids(world.sharing_location().duplicates()) == [] and ids(world.orphans()) == []
    from .town import library_of

    bare = library_of(spark, {}, {70: (5, 5, {}), 71: (5, 5, {}), 72: (6, 6, {"a": "b"})})
    assert ids(bare.duplicates()) == [70, 71] and ids(bare.orphans()) == [70, 71]


def test_geometry_in_and_out(world):
    from terrafold.functions import geometry
    from terrafold.functions.mercator import Plane

    lon, lat = Plane.lon, Plane.lat
    text = "POLYGON((" + ",".join(f"{lon(x):.12f} {lat(y):.12f}" for x, y in [(0, 0), (100, 0), (100, 100), (0, 100), (0, 0)]) + "))"
    assert ids(world.nodes("n[amenity]").within(text)) == [1, 4] and ids(world.nodes("n[amenity]").within(geometry.to_wkb(geometry.parse_wkt(text)))) == [1, 4]
    texts = {
        "POINT(1 -2.5)": ("POINT", [(1.0, -2.5)]), "point empty": ("POINT", []), "LINESTRING Z (1 2 9,3 4 9)": ("LINESTRING", [(1.0, 2.0), (3.0, 4.0)]),
        "POLYGON((0 0,1 0,1 1,0 0),(0 0,1e-3 0,0 1,0 0))": ("POLYGON", [[(0, 0), (1, 0), (1, 1), (0, 0)], [(0, 0), (0.001, 0), (0, 1), (0, 0)]]),
        "MULTIPOINT(1 2,(3 4))": ("MULTIPOINT", [(1, 2), (3, 4)]), "MULTILINESTRING((1 2,3 4),(5 6,7 8))": ("MULTILINESTRING", [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]),
        "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))": ("MULTIPOLYGON", [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]),
        "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(1 2,3 4))": ("GEOMETRYCOLLECTION", [("POINT", [(1, 2)]), ("LINESTRING", [(1, 2), (3, 4)])]),
    }
    for t, want in texts.items():
        assert geometry.parse_wkt(t) == want and geometry.parse_wkb(geometry.to_wkb(want)) == want, t
    for bad in ("", "POINT", "POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "POINT(1 2) x", "LINESTRING((1 2))"):
        with pytest.raises(geometry.GeometryError):
            geometry.parse_wkt(bad)
    wkt = {r.typed_id: r.geometry for r in world.geometries("wkt", 9).collect()}
    wkb = {r.typed_id: bytes(r.geometry) for r in world.geometries("wkb").collect()}
    assert {k: geometry.parse_wkb(v) for k, v in wkb.items()} == {k: geometry.parse_wkt(v) for k, v in wkt.items()}


def test_map_draws_relations_and_never_drops_features(world):
    page = world.relations().map_html()
    # the area with its hole as one polygon; the route's ways and stop; the networks' members through each other
    assert page.count("L.polygon(") == 1 and page.count("L.polyline(") == 3 * 2 and page.count("L.circleMarker(") == 1 + 2 * 2
    with pytest.raises(ValueError, match="more than 2"):
        world.map_html(most=2)


def test_measures_and_output(world):
    meters = 40075016.68558 / 4294967294.9999
    assert world("w[highway=primary]").length() == pytest.approx(200 * meters, rel=1e-6)
    assert world("a[leisure]").area() == pytest.approx(10000 * meters**2, rel=1e-6)
    assert world.relations("a").area() == pytest.approx((10000 - 400) * meters**2, rel=1e-6)
    c = {r.typed_id: (r.cx, r.cy) for r in world("a").centroids().collect()}
    assert c[401] == (50, 50) and c[4002] == pytest.approx((50, 50))
    assert ids(world.ways().with_area(low=1e-9)) == [100] and 105 not in ids(world.ways().with_length(high=200 * meters))
    collection = [json.loads(r.geojson) for r in world("a").geojson().collect()]
    kinds = {f["id"]: f["geometry"] for f in collection}
    assert kinds["W100"]["type"] == "Polygon" and len(kinds["R1000"]["coordinates"]) == 2
    assert json.loads(world("n[amenity=pub]").geojson().first().geojson)["properties"] == {"amenity": "pub", "name": "Crown", "stars": 4}
    row = world("n[amenity=pub]").rows("id,name,st*,amenity").first()
    assert tuple(row) == ("N1", "Crown", "pub", '{"stars":4}')
    wkt = {r.typed_id: r.geometry for r in world.relations().geometries().collect()}
    assert wkt[4002].startswith("POLYGON((") and wkt[1001 * 4 + 2].startswith("GEOMETRYCOLLECTION(POINT(") and "L.polygon(" in world("a").map_html()


def test_library_round_trip(world, spark, tmp_path):
    world.lib.write(str(tmp_path / "lib"))
    again = Library.open(spark, str(tmp_path / "lib"))
    assert again.features.count() == world.lib.features.count() and again.way_nodes.count() == world.lib.way_nodes.count()
    assert again.indexed == world.lib.indexed and again.meta["revision"] == 1 and len(again.meta["guid"]) == 36
    with pytest.raises(LibraryError):
        Library.open(spark, str(tmp_path / "lib"), indexed=("other",))
    again.write(str(tmp_path / "next"), source="town")
    meta = Library.open(spark, str(tmp_path / "next")).meta
    assert (meta["revision"], meta["guid"], meta["properties"]) == (2, again.meta["guid"], {"source": "town"})
    Features.of(again)("n[amenity]").lib.write(str(tmp_path / "lib"))
    assert Library.open(spark, str(tmp_path / "lib")).meta["revision"] == 2 and again.features.count() == world.lib.features.count()
    assert Library.open(spark, str(tmp_path / "lib"), revision=1).meta["revision"] == 1
    with pytest.raises(LibraryError):
        Library.open(spark, str(tmp_path / "lib"), revision=3)
    assert all(r.cell == again.features.first().cell for r in again.tile(again.features.first().cell).collect()) and again.tile(-7).count() == 0
    with pytest.raises(LibraryError):
        Library.open(spark, str(tmp_path / "none"))
    from terrafold.streaming.tagstream import matching, read_features

    q = matching(read_features(spark, str(tmp_path / "lib/features")), "n[amenity]", Box(5, 5, 20, 20)).writeStream.format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.sql("SELECT id FROM hits").collect()) == [1, 4]


def test_xml_import(spark, tmp_path):
    from terrafold.sources import osm_xml

    (tmp_path / "a.osm").write_text("""<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="0.0" lon="0.0"><tag k="amenity" v="pub"/><tag k="name" v="A &amp; B"/></node><node id="2" lat="0.1" lon="0.0"/><node id="3" lat="0.1" lon="0.1"/>
<way id="7"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>
<relation id="9"><member type="way" ref="7" role="outer"/><member type="node" ref="99" role="x"/><tag k="type" v="multipolygon"/></relation></osm>""")
    lib = osm_xml.read(spark, str(tmp_path / "a.osm"))
    got = {(r.type, r.id): r for r in lib.features.collect()}
    assert set(got) == {(0, 1), (1, 7), (2, 9)} and got[0, 1].tags["name"] == "A & B"
    assert got[1, 7].is_area and got[1, 7].is_member and got[2, 9].is_area and got[2, 9].max_x == got[1, 7].max_x
    assert [r.node_id for r in lib.way_nodes.orderBy("seq").collect()] == [1, 2, 3, 1]


def test_relations_nest_at_any_depth(spark):
    from terrafold.operators.related import closure
    from terrafold.sources.library import derive

    deep = 36
    nodes = spark.createDataFrame([(1, 7, 9, {"a": "b"})], "id long, x int, y int, tags map<string,string>")
    ways = spark.createDataFrame([], "id long, tags map<string,string>")
    relations = spark.createDataFrame([(k, {"type": "network"}) for k in range(deep)], "id long, tags map<string,string>")
    rows = [(k, 0, 2, k + 1, "") for k in range(deep - 1)] + [(deep - 1, 0, 0, 1, "")]
    members = spark.createDataFrame(rows, "rel_id long, seq int, m_type int, m_id long, role string")
    lib = derive(nodes, ways, relations, spark.createDataFrame([], "way_id long, seq int, node_id long, x int, y int"), members)
    assert {(r.min_x, r.max_y) for r in lib.features.where("type = 2").select("min_x", "max_y").collect()} == {(7, 9)}
    found = closure(lib, spark.createDataFrame([(2, 0)], "type int, id long")).where("m_type = 0").collect()
    assert [r.m_id for r in found] == [1]


def test_collections_join_once_and_in_pieces(spark, world, monkeypatch):
    """A union's tables aren't each joined with the members, and texts joined in steps keep their order."""
    found = open_star(spark, "/root/testdata/sf0.001")
    plan = Features.of(found).relations("r").geometries()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi, (typed_id" not in plan
    want = {r.typed_id: r.geometry for r in world.relations().geometries("geojson").collect()}
    monkeypatch.setattr(features, "PIECE_BITS", 2)
    got = {r.typed_id: r.geometry for r in world.relations().geometries("geojson").collect()}
    assert got == want and [g["type"] for g in json.loads(got[1001 * 4 + 2])["geometries"]] == ["Point", "LineString", "LineString"]
    assert len(json.loads(got[1002 * 4 + 2])["geometries"]) == 4
