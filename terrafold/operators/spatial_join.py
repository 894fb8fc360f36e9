"""Points joined with many polygons: an equi-join on map tiles with an exact test where a boundary runs.

A polygon is covered by the tiles of a zoom that suits its size, COVER at most along each side. Tiles that no
edge meets are wholly in or out, so their points need no test. In the others a point is tested against the edges
that a ray from it can meet, not against the whole polygon.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.box import Tile, column_from_x, row_from_y
from ..sources.scratch import materialize
from .kernel import edges_of, locate

COVER, ZOOMS = 24, range(0, 13)
CELLS = "polygon long, zoom int, col int, row int, inside boolean, edges array<bigint>"


def cover(points: np.ndarray) -> Iterator[tuple[int, int, int, bool, list[int] | None]]:
    """(zoom, column, row, wholly inside, edges to test or None) of the tiles that may hold points of a ring."""
    e = edges_of(points)
    low, high = points.min(0), points.max(0)
    zoom = max(z for z in ZOOMS if z == 0 or max(high - low) >> (32 - z) < COVER)
    first, last = Tile.at(int(low[0]), int(high[1]), zoom), Tile.at(int(high[0]), int(low[1]), zoom)
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    bottom, top = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    for row in range(first.row, last.row + 1):
        for column in range(first.column, last.column + 1):
            b = Tile(zoom, column, row).bounds
            beside = (bottom <= b.max_y) & (top >= b.min_y)
            if (beside & (left <= b.max_x) & (right >= b.min_x)).any():
                # locate() counts edges on the other side as well, in even numbers or not at all: all in the band are kept
                yield zoom, column, row, False, e[beside].ravel().tolist()
            elif locate(np.asarray([b.min_x]), np.asarray([b.min_y]), e)[0] >= 0:
                yield zoom, column, row, True, None


def points_in_polygons(points: DataFrame, polygons: DataFrame, strict: bool = True) -> DataFrame:
    """Columns of points with polygon: an id for each polygon (id, points) that holds the point.

    ``strict`` leaves out points on boundaries. Polygons are closed rings. Points need min_x and min_y. A tile
    may hold a large share of all points: AQE splits such partitions of the join.
    """

    def covers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for number, ring in zip(pdf["id"], pdf["points"], strict=True):
                p = np.asarray([(q["x"], q["y"]) for q in ring], "i8").reshape(-1, 2)
                if len(p) > 3:
                    yield pd.DataFrame([(number, *c) for c in cover(p)], columns=["polygon", "zoom", "col", "row", "inside", "edges"])

    @F.pandas_udf("tinyint")
    def at(x: pd.Series, y: pd.Series, polygon: pd.Series, col: pd.Series, row: pd.Series, edges: pd.Series) -> pd.Series:
        out = np.full(len(x), -1, "i1")
        frame = pd.DataFrame({"p": polygon, "c": col, "r": row})[edges.notna().to_numpy()]
        px, py = x.to_numpy("i8"), y.to_numpy("i8")
        for _, rows in frame.groupby(["p", "c", "r"]).groups.items():
            e = np.asarray(edges[rows[0]], "i8").reshape(-1, 4)
            out[rows] = locate(px[rows], py[rows], e)
        return pd.Series(out)

    # written once: both the zooms and the join read it, and Spark broadcasts it only if its files are small
    cells = materialize(polygons.select("id", "points").mapInPandas(covers, CELLS), "cells")
    zooms = sorted(r["zoom"] for r in cells.select("zoom").distinct().collect())  # at most 13 rows
    tiled = points.withColumn("zoom", F.explode(F.array(*map(F.lit, zooms)) if zooms else F.expr("array()").cast("array<int>")))
    col, row = F.lit(None).cast("int"), F.lit(None).cast("int")
    for z in zooms:
        col = F.when(F.col("zoom") == z, column_from_x(F.col("min_x"), z)).otherwise(col)
        row = F.when(F.col("zoom") == z, row_from_y(F.col("min_y"), z)).otherwise(row)
    joined = tiled.withColumn("col", col).withColumn("row", row).join(cells, ["zoom", "col", "row"])
    test = at("min_x", "min_y", "polygon", "col", "row", "edges")
    return joined.where(F.col("inside") | (test > 0 if strict else test >= 0)).select(*points.columns, "polygon")
