"""Polygons of area relations: rings from member ways, holes dealt to outer rings. A relation is one group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import edges_of, locate

RINGS = "rel_id long, polygon int, ring int, points array<struct<x:int,y:int>>"


def assemble(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings from lines joined at shared ends, in the order of the lines; what doesn't close is left out."""
    rings, at = [], {}
    open_ = [p for p in lines if len(p) > 1]
    used = [False] * len(open_)
    for k, p in enumerate(open_):
        for end in {tuple(p[0]), tuple(p[-1])}:
            at.setdefault(end, []).append(k)
    for k, p in enumerate(open_):
        if used[k]:
            continue
        used[k], chain = True, [p]
        first, last = tuple(p[0]), tuple(p[-1])
        while first != last:
            nxt = next((j for j in at.get(last, ()) if not used[j]), None)
            if nxt is None:
                break
            used[nxt] = True
            q = open_[nxt] if tuple(open_[nxt][0]) == last else open_[nxt][::-1]
            chain.append(q[1:])
            last = tuple(q[-1])
        if first == last:
            ring = np.concatenate(chain)
            if len(ring) > 3:
                rings.append(ring)
    return rings


def size(ring: np.ndarray) -> float:
    p = (ring - ring[0]).astype("f8")
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def without_shared_edges(holes: list[np.ndarray]) -> list[np.ndarray]:
    """Holes that share edges become one ring: edges in two of them cancel out."""
    if len(holes) < 2:
        return holes
    count: dict = {}
    for h in holes:
        for a, b in zip(map(tuple, h[:-1]), map(tuple, h[1:]), strict=True):
            count[min(a, b), max(a, b)] = count.get((min(a, b), max(a, b)), 0) + 1
    if max(count.values()) < 2:
        return holes
    return assemble([np.asarray(e) for e, n in count.items() if n % 2])


def polygons(outer: list[np.ndarray], inner: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Each outer ring with its holes. A hole goes to the only outer ring, or the first that holds its first vertex, or the largest."""
    outers = assemble(outer)
    if not outers:
        return []
    found = [[ring] for ring in outers]
    largest = max(range(len(outers)), key=lambda k: len(outers[k]))
    held: dict[int, list] = {}
    for hole in assemble(inner):
        home = 0
        if len(outers) > 1:
            inside = (k for k, ring in enumerate(outers) if (locate(hole[:, 0], hole[:, 1], edges_of(ring)) >= 0).all())
            home = next(inside, largest)
        held.setdefault(home, []).append(hole)
    for home, holes in held.items():
        found[home] += without_shared_edges(holes)
    return found


def polygonize(relations: DataFrame, members: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """Rows of RINGS for relations (id): ring 0 of a polygon is its outer one. Relations without closed rings give none."""
    ways = members.where("m_type = 1").where(F.col("role").isin("outer", "inner")).join(relations.select(F.col("id").alias("rel_id")), "rel_id", "left_semi")
    lines = (
        ways.join(way_nodes.withColumnRenamed("seq", "n"), ways.m_id == way_nodes.way_id)
        .groupBy("rel_id", "seq", "role").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("p"))
        .select("rel_id", "seq", "role", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))
    )

    def rings(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        parts = {r: [np.stack([np.asarray(x), np.asarray(y)], 1) for x, y in zip(g["xs"], g["ys"], strict=True)] for r, g in pdf.groupby("role")}
        out = []
        for k, polygon in enumerate(polygons(parts.get("outer", []), parts.get("inner", []))):
            for n, ring in enumerate(polygon):
                out.append((pdf["rel_id"].iloc[0], k, n, [{"x": int(x), "y": int(y)} for x, y in ring]))
        return pd.DataFrame(out, columns=["rel_id", "polygon", "ring", "points"])

    return lines.groupBy("rel_id").applyInPandas(rings, RINGS)
