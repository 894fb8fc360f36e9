import random
from fractions import Fraction

import numpy as np

from terrafold.functions.box import Box, Tile
from terrafold.operators.kernel import edges_of, locate, meets
from terrafold.operators.rings import assemble, polygons, size


def brute(x, y, ring):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
            return 0
        if (y1 <= y) != (y2 <= y) and x < x1 + Fraction((y - y1) * (x2 - x1), y2 - y1):
            odd = not odd
    return 1 if odd else -1


def test_locate_is_exact():
    rng = random.Random(1)
    for top in (5, 2**31 - 1):
        for _ in range(60):
            ring = [(rng.randint(-top, top), rng.randint(-top, top)) for _ in range(rng.randint(3, 9))]
            ring.append(ring[0])
            pts = [(rng.randint(-top, top), rng.randint(-top, top)) for _ in range(30)] + ring
            got = locate(np.asarray([p[0] for p in pts]), np.asarray([p[1] for p in pts]), edges_of(np.asarray(ring)))
            assert got.tolist() == [brute(*p, ring) for p in pts]


def test_meets():
    e = lambda *v: np.asarray([v], "i8")
    assert meets(e(0, 0, 10, 10), e(0, 10, 10, 0)) and meets(e(0, 0, 5, 5), e(5, 5, 9, 0)) and not meets(e(0, 0, 4, 4), e(5, 5, 9, 9))
    assert not meets(e(-(2**31), -(2**31), 2**31 - 1, 2**31 - 2), e(0, 0, -1, 1)[:0]) and not meets(e(0, 0, 2**31 - 1, 2**31 - 2), e(1, 1, 2, 2) + e(0, 0, -1, 0))


def test_rings_and_holes():
    a, b = np.asarray([(0, 0), (10, 0), (10, 10)]), np.asarray([(0, 0), (0, 10), (10, 10)])
    ring = assemble([a, b])[0]
    assert abs(size(ring)) == 100 and assemble([a]) == []
    hole = lambda x: np.asarray([(x, 2), (x + 2, 2), (x + 2, 4), (x, 4), (x, 2)])
    found = polygons([a, b], [hole(2), hole(4)])
    assert len(found) == 1 and len(found[0]) == 2 and abs(size(found[0][1])) == 8  # holes that share an edge are one
    other = ring + np.asarray([100, 0])
    assert [len(p) for p in polygons([ring, other], [hole(102)])] == [1, 2]


def test_boxes_and_tiles():
    wrap = Box(2_000_000_000, -5, -2_000_000_000, 5)
    assert wrap.contains(2_100_000_000, 0) and wrap.contains(-2_100_000_000, 0) and not wrap.contains(0, 0)
    assert wrap.intersects(Box(-2_100_000_000, 0, -2_050_000_000, 1)) and not wrap.intersects(Box(-10, 0, 10, 1))
    assert Box.empty().is_empty and Box.world().contains(5, 5) and Box(0, 0, 1, 1).buffered(2) == Box(-2, -2, 3, 3)
    assert Box.around(2**31 - 10, 0, 100).wraps
    for z in (0, 1, 6, 12):
        for x, y in ((0, 0), (-(2**31), 2**31 - 1), (2**31 - 1, -(2**31)), (123456789, -987654321)):
            t = Tile.at(x, y, z)
            assert t.bounds.contains(x, y) and t.zoomed_out(0) == Tile(0, 0, 0)


def test_hilbert_curve_visits_every_tile_by_single_steps(spark):
    from pyspark.sql import functions as F

    from terrafold.functions.box import Tile, hilbert, tile_pair

    tiles = [(c, r) for c in range(16) for r in range(16)]
    rows = spark.createDataFrame(tiles, "c int, r int").select("c", "r", hilbert(F.col("c"), F.col("r"), 4).alias("d")).collect()
    path = [(r.c, r.r) for r in sorted(rows, key=lambda r: r.d)]
    assert sorted(r.d for r in rows) == list(range(256)) and all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(path, path[1:], strict=False))
    t = lambda z, c, r: Tile(z, c, r)
    assert tile_pair([]) == () and tile_pair([t(3, 1, 1)]) == (t(3, 1, 1),)
    assert tile_pair([t(3, 1, 1), t(3, 2, 1)]) == (t(3, 1, 1), t(3, 2, 1)) and tile_pair([t(3, 1, 1), t(3, 2, 2)]) == (t(1, 0, 0),)
    assert tile_pair([t(3, 1, 1), t(2, 1, 0)]) == (t(2, 0, 0), t(2, 1, 0))


def test_edges_of_many_against_pairs():
    from terrafold.operators.kernel import each_meets, meets

    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(-9, 9, (60, 4)), rng.integers(-9, 9, (30, 4))
        got = each_meets(a, b)
        assert got.tolist() == [meets(a[k : k + 1], b) for k in range(60)]
        slow = [any(crosses(p, q) for q in b.tolist()) for p in a.tolist()]
        assert got.tolist() == slow


def crosses(p, q):
    """Whether two segments share a point, in exact arithmetic."""
    turn = lambda ax, ay, bx, by, cx, cy: (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    on = lambda s, x, y: turn(*s, x, y) == 0 and min(s[0], s[2]) <= x <= max(s[0], s[2]) and min(s[1], s[3]) <= y <= max(s[1], s[3])
    if on(p, *q[:2]) or on(p, *q[2:]) or on(q, *p[:2]) or on(q, *p[2:]):
        return True
    return (turn(*p, *q[:2]) > 0) != (turn(*p, *q[2:]) > 0) and (turn(*q, *p[:2]) > 0) != (turn(*q, *p[2:]) > 0) and 0 not in (turn(*p, *q[:2]), turn(*p, *q[2:]), turn(*q, *p[:2]), turn(*q, *p[2:]))
