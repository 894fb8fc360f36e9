"""Import of binary extracts, from files encoded here, against what was encoded."""

import struct
import zlib

import numpy as np
import pytest

from terrafold.functions.mercator import Plane
from terrafold.sources import osm_pbf


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def zig(n):
    return (n << 1) ^ (n >> 63)


def packed(values):
    return b"".join(map(varint, values))


def deltas(values):
    return packed(zig(b - a) for a, b in zip([0, *values], values))


def blob(kind, data, compressed=True):
    body = field(3, zlib.compress(data)) + field(2, len(data)) if compressed else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


NODES = {5: (0.5, -0.25, {"amenity": "pub", "name": "Ä & Ö"}), -3: (0.0, 0.0, {}), 9: (0.5, 0.5, {}), 12: (-179.9, 85.0, {"a": "b"})}
WAYS = {7: ([-3, 5, 9, -3], {"building": "yes"}), 8: ([9, 99, 5], {"highway": "track"})}
RELATIONS = {4: ([(1, 7, "outer"), (0, 5, "label"), (0, 98, "gone")], {"type": "multipolygon"})}


def encoded(dense, compressed, needs="DenseNodes"):
    texts = [""] + sorted({t for _, _, tags in NODES.values() for kv in tags.items() for t in kv} | {t for _, tags in [*WAYS.values(), *RELATIONS.values()] for kv in tags.items() for t in kv} | {"outer", "label", "gone"})
    at = {t: k for k, t in enumerate(texts)}
    units = lambda v: round(v * 1e7)
    named = lambda tags: field(2, packed(at[k] for k in tags)) + field(3, packed(at[v] for v in tags.values()))
    if dense:
        keys = [x for _, _, tags in NODES.values() for x in [*(at[t] for kv in tags.items() for t in kv), 0]]
        nodes = field(2, field(1, deltas(list(NODES))) + field(8, deltas([units(n[1]) for n in NODES.values()])) + field(9, deltas([units(n[0]) for n in NODES.values()])) + field(10, packed(keys)))
    else:
        nodes = b"".join(field(1, varint(1 << 3) + varint(zig(i)) + named(t) + varint(8 << 3) + varint(zig(units(lat))) + varint(9 << 3) + varint(zig(units(lon)))) for i, (lon, lat, t) in NODES.items())
    ways = b"".join(field(3, field(1, i) + named(t) + field(8, deltas(refs))) for i, (refs, t) in WAYS.items())
    rels = b"".join(field(4, field(1, i) + named(t) + field(8, packed(at[r] for *_, r in ms)) + field(9, deltas([m for _, m, _ in ms])) + field(10, packed(k for k, *_ in ms))) for i, (ms, t) in RELATIONS.items())
    table = field(1, b"".join(field(1, t.encode()) for t in texts))
    parts = [blob("OSMHeader", field(4, b"OsmSchema-V0.6") + field(4, needs.encode()), compressed)]
    parts += [blob("OSMData", table + field(2, g) + field(17, 100), compressed) for g in (nodes, ways, rels)]
    return b"".join(parts)


@pytest.mark.parametrize("dense", [True, False])
def test_elements(dense):
    found = [e for kind, b in osm_pbf.blobs(encoded(dense, dense)) if kind == "OSMData" for e in osm_pbf.elements(osm_pbf.content(b))]
    assert {e[1]: (round(e[2], 9), round(e[3], 9), dict(e[4])) for e in found if e[0] == 0} == NODES
    assert {e[1]: (e[5], dict(e[4])) for e in found if e[0] == 1} == WAYS
    assert {e[1]: (list(zip(e[6], e[5], e[7], strict=True)), dict(e[4])) for e in found if e[0] == 2} == RELATIONS


def test_packed_numbers():
    values = [0, 1, 127, 128, 300, 2**32, 2**63, 2**64 - 1]
    assert osm_pbf.packed(packed(values)).tolist() == values and osm_pbf.packed(b"").tolist() == []
    assert osm_pbf.zigzag(np.asarray([zig(v) & (2**64 - 1) for v in (0, -1, 1, -(2**40))], "u8")).tolist() == [0, -1, 1, -(2**40)]


def test_library(spark, tmp_path):
    (tmp_path / "a.pbf").write_bytes(encoded(True, True))
    lib = osm_pbf.read(spark, str(tmp_path / "a.pbf"))
    got = {(r.type, r.id): r for r in lib.features.collect()}
    assert set(got) == {(0, 5), (0, 12), (1, 7), (1, 8), (2, 4)} and got[0, 5].tags["name"] == "Ä & Ö"
    assert got[1, 7].is_area and [(p.x, p.y) for p in got[1, 8].points] == [(Plane.x(0.5), Plane.y(0.5)), (Plane.x(0.5), Plane.y(-0.25))]
    assert got[2, 4].is_area and got[2, 4].max_x == got[1, 7].max_x
    (tmp_path / "b.pbf").write_bytes(encoded(True, True, needs="LocationsOnWays"))
    with pytest.raises(Exception, match="LocationsOnWays"):
        osm_pbf.rows(spark, str(tmp_path / "b.pbf")).count()
    with pytest.raises(osm_pbf.PbfError):
        list(osm_pbf.blobs(encoded(True, True)[:-5]))
