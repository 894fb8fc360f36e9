"""Planar tests on numpy arrays of integer coordinates.

Signs of cross products are exact: a product of two coordinate differences has at most 64 bits, which an
80-bit float holds, and a rounded difference of two such numbers has the right sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

WIDE = np.longdouble


@dataclass(frozen=True)
class Shape:
    """A test geometry: "point", "line" or "polygon", with edges (x1, y1, x2, y2), bounds and the first vertex of each part."""

    kind: str
    edges: np.ndarray
    starts: np.ndarray
    bounds: tuple[int, int, int, int] = field(default=(0, 0, 0, 0))

    @staticmethod
    def of(kind: str, parts: list[np.ndarray]) -> Shape:
        """From vertex arrays (n, 2). A point is one part of one vertex."""
        parts = [np.asarray(p, "i8").reshape(-1, 2) for p in parts if len(p)]
        if not parts:
            return Shape(kind, np.empty((0, 4), "i8"), np.empty((0, 2), "i8"), (1, 1, 0, 0))
        every = np.concatenate(parts)
        edges = np.concatenate([np.hstack([p[:-1], p[1:]]) for p in parts]) if kind != "point" else np.empty((0, 4), "i8")
        low, high = every.min(0), every.max(0)
        return Shape(kind, edges, np.stack([p[0] for p in parts]), (int(low[0]), int(low[1]), int(high[0]), int(high[1])))


def side(ax, ay, bx, by, px, py) -> np.ndarray:
    """Sign of the turn from a over b to p."""
    left = (bx - ax).astype(WIDE) * (py - ay).astype(WIDE)
    right = (by - ay).astype(WIDE) * (px - ax).astype(WIDE)
    return np.sign(left - right).astype("i1")


def locate(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each point against a polygon's edges: 1 inside, 0 on the boundary, -1 outside."""
    x, y = np.asarray(x, "i8"), np.asarray(y, "i8")
    out = np.full(len(x), -1, "i1")
    if not len(edges):
        return out
    for at in range(0, len(x), max(1, 2_000_000 // len(edges))):
        px, py = x[at : at + max(1, 2_000_000 // len(edges)), None], y[at : at + max(1, 2_000_000 // len(edges)), None]
        x1, y1, x2, y2 = (edges[:, k][None] for k in range(4))
        s = side(x1, y1, x2, y2, px, py)
        within = (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
        edge = ((s == 0) & within).any(1)
        up, down = (y1 <= py) & (py < y2) & (s > 0), (y2 <= py) & (py < y1) & (s < 0)
        odd = (up | down).sum(1) % 2 == 1
        out[at : at + len(px)] = np.where(edge, 0, np.where(odd, 1, -1))
    return out


def on_edges(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Whether each point is on one of the segments."""
    if not len(edges):
        return np.zeros(len(x), bool)
    px, py = np.asarray(x, "i8")[:, None], np.asarray(y, "i8")[:, None]
    x1, y1, x2, y2 = (edges[:, k][None] for k in range(4))
    near = (np.minimum(x1, x2) <= px) & (px <= np.maximum(x1, x2)) & (np.minimum(y1, y2) <= py) & (py <= np.maximum(y1, y2))
    return (near & (side(x1, y1, x2, y2, px, py) == 0)).any(1)


def edges_of(points: np.ndarray) -> np.ndarray:
    return np.hstack([points[:-1], points[1:]])


def meets(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment of a meets one of b; touching counts."""
    return bool(each_meets(a, b).any())


def pairs_near(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of segments of a and b whose bounds touch, in runs."""
    if not len(a) or not len(b):
        return
    # only what lies in the other's bounds is compared
    low, high = np.minimum(b[:, :2], b[:, 2:]).min(0), np.maximum(b[:, :2], b[:, 2:]).max(0)
    mine = np.flatnonzero((np.maximum(a[:, :2], a[:, 2:]) >= low).all(1) & (np.minimum(a[:, :2], a[:, 2:]) <= high).all(1))
    # b in order of its lower ends: a segment of a meets only those that begin below its upper end
    bottom, top = np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3])
    order = np.argsort(bottom, kind="stable")
    left, right = np.minimum(b[:, 0], b[:, 2])[order][None], np.maximum(b[:, 0], b[:, 2])[order][None]
    bottom, top = bottom[order], top[order][None]
    for at in range(0, len(mine), max(1, 1_000_000 // len(b))):
        i = mine[at : at + max(1, 1_000_000 // len(b))]
        p = a[i]
        until = int(np.searchsorted(bottom, np.maximum(p[:, 1], p[:, 3]).max(), side="right"))
        x1, x2 = np.minimum(p[:, 0], p[:, 2])[:, None], np.maximum(p[:, 0], p[:, 2])[:, None]
        y1, y2 = np.minimum(p[:, 1], p[:, 3])[:, None], np.maximum(p[:, 1], p[:, 3])[:, None]
        m, j = np.nonzero((x1 <= right[:, :until]) & (left[:, :until] <= x2) & (y1 <= top[:, :until]) & (bottom[None, :until] <= y2))
        if len(m):
            yield i[m], order[j]


def turns(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of segments: whether q's ends lie on two sides of p (-1), on it (0) or on one (1); and p's ends of q."""
    one = side(p[:, 0], p[:, 1], p[:, 2], p[:, 3], q[:, 0], q[:, 1]) * side(p[:, 0], p[:, 1], p[:, 2], p[:, 3], q[:, 2], q[:, 3])
    two = side(q[:, 0], q[:, 1], q[:, 2], q[:, 3], p[:, 0], p[:, 1]) * side(q[:, 0], q[:, 1], q[:, 2], q[:, 3], p[:, 2], p[:, 3])
    return one, two


def each_meets(a: np.ndarray, b: np.ndarray, through: bool = False) -> np.ndarray:
    """Whether each segment of a meets one of b; touching counts, unless it has to run through."""
    found = np.zeros(len(a), bool)
    for i, j in pairs_near(a, b):
        one, two = turns(a[i], b[j])
        found[i[(one < 0) & (two < 0) if through else (one <= 0) & (two <= 0)]] = True
    return found


def inside_points(shape: Shape, rings: np.ndarray) -> np.ndarray:
    """Points of a shape that lie in an area with these edges, or on its boundary, if the shape does; doubled.

    Vertices, and the middles of edges cut where vertices of the area lie on them: between these an edge is in or out.
    """
    points = [2 * shape.starts, 2 * shape.edges[:, :2], 2 * shape.edges[:, 2:]]
    corners = rings[:, :2]
    for e in shape.edges:
        on = corners[on_edges(corners[:, 0], corners[:, 1], e[None])] if len(corners) else corners
        along = np.concatenate([e[None, :2], on, e[None, 2:]])
        along = along[np.argsort(((along - e[:2]) ** 2).sum(1), kind="stable")]
        points.append(along[1:] + along[:-1])
    return np.unique(np.concatenate(points), axis=0)


def holds(rings: np.ndarray, shape: Shape) -> bool:
    """Whether an area, given by all edges of its rings, holds a whole shape; boundaries count."""
    if not len(rings) or each_meets(shape.edges, rings, through=True).any():
        return False
    if shape.kind == "polygon" and (locate(rings[:, 0], rings[:, 1], shape.edges) > 0).any():
        return False  # a boundary runs inside the shape: a hole
    points = inside_points(shape, rings)
    return bool((locate(points[:, 0], points[:, 1], 2 * rings) >= 0).all())


def distance(a: Shape, b: Shape) -> float:
    """Units between the nearest points of two shapes; 0 if they meet or one holds the other."""
    for one, two in ((a, b), (b, a)):
        if two.kind == "polygon" and len(one.starts) and (locate(one.starts[:, 0], one.starts[:, 1], two.edges) >= 0).any():
            return 0.0
    if each_meets(a.edges, b.edges).any():
        return 0.0
    least = float("inf")
    for one, two in ((a, b), (b, a)):
        ends = np.unique(np.concatenate([one.starts, one.edges[:, :2], one.edges[:, 2:]]), axis=0)
        other = two.edges if len(two.edges) else np.hstack([two.starts, two.starts])
        for x, y in ends.tolist() if len(other) else ():
            least = min(least, float(segment_distance(x, y, other).min()))
    return least


def segment_distance(x: float, y: float, edges: np.ndarray) -> np.ndarray:
    """Units from a point to each segment."""
    e = edges.astype("f8")
    dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
    n = dx * dx + dy * dy
    t = np.clip(np.where(n > 0, ((x - e[:, 0]) * dx + (y - e[:, 1]) * dy) / np.where(n > 0, n, 1), 0), 0, 1)
    return np.hypot(e[:, 0] + t * dx - x, e[:, 1] + t * dy - y)
