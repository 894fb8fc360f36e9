"""Exact top-k by integer inner product over a pivot-distance index.

Vectors get one more component that makes all lengths equal, so the inner product orders them as the
distance d to the query does: score = (|q|^2 + M^2 - d^2) / 2, M the greatest length. A vector's key is its
nearest pivot and its distance to it. Sorted by key, vectors are cut into annuli (blocks of one pivot and a
range of distances). A query first meets the annulus it lies in itself; its k-th score there bounds the
distance from above, and by the triangle inequality only annuli within it can hold better vectors. Of these
the nearest are searched first, ring after ring; each ring's scores draw the bound closer, and a query stops
when the next ring lies beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

#: Pivots at least and at most, as the square root of the number of annuli; the bounded sample that they're chosen from.
PIVOTS, SAMPLE = (24, 512), 2048
#: Dimensions with pivots of their own, the most frequent ones; all others have the origin as their one pivot.
DIMENSIONS = 1000
#: Rings of a search, as shares of the distance that bounds a query.
RINGS = (0.4, 0.7, 1.0)
#: Vectors of an annulus, and queries of a block, at most.
ANNULUS, QUERIES = 2048, 256
#: Room for rounding in bounds, relative.
SLACK = 1e-9


def quantized(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each vector, without those that are null or hold nulls or non-finite numbers.

    Of rows repeated with one vec_id the least vector counts.
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    one = vectors.where(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(x).alias("x"))
    return one.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample that lie far apart: each next one is the farthest from those chosen."""
    chosen, far = [0], None
    for _ in range(min(count, len(sample)) - 1):
        d = ((sample - sample[chosen[-1]]) ** 2).sum(1)
        far = d if far is None else np.minimum(far, d)
        if far.max() == 0:
            break
        chosen.append(int(far.argmax()))
    return sample[chosen]


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([v, np.sqrt(np.maximum(0, most - (v * v).sum(1)))[:, None]])


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T
    return np.sqrt(np.maximum(0, d))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products; floats are exact while products stay below 2^53."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1]) < 2**52:
        return (q.astype("f8") @ v.astype("f8").T).astype("i8")
    return q @ v.T


def best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score, ties to the smaller id."""
    if len(s) > 4 * k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= least)
    else:
        at = np.arange(len(s))
    return at[np.lexsort((ids[at], -s[at]))][:k]


NONE = np.iinfo("i8").min
INDEX = "dim int, pivot int, low double, high double, ids binary, v binary, kind string, radius binary, block long"


class Space:
    """Pivots and the greatest squared length, for one dimension."""

    def __init__(self, pivots: np.ndarray, most: float):
        self.most, self.pivots = most, lifted(pivots.astype("f8"), most)

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(lifted(v.astype("f8"), self.most), self.pivots)
        at = d.argmin(1)
        return at, d[np.arange(len(v)), at]

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return distances(np.hstack([q.astype("f8"), np.zeros((len(q), 1))]), self.pivots)

    def radius(self, q: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Distance within which any vector of a score of kth or more lies."""
        q2 = (q.astype("f8") ** 2).sum(1)
        r = np.sqrt(np.maximum(0, q2 + self.most - 2 * kth.astype("f8")))
        return np.where(kth == NONE, np.inf, r + SLACK * (1 + r + np.sqrt(self.most)))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors among all others of its dimension.

    Queries are the vectors whose vec_id is divisible by ``every``. Fewer than k candidates give fewer rows;
    equal vectors and scores are ordered by vec_id; an empty table gives none; other columns aren't read. Vectors so long that scores exceed 64 bits are an error.
    """
    spark = vectors.sparkSession
    rows = materialize(quantized(vectors, scale), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    by_dim = materialize(rows.groupBy("dim").agg(F.max(square).alias("most"), F.count("*").alias("n")), "dimensions")
    most = by_dim.agg(F.max("most")).first()[0] or 0.0
    if most >= 2.0**62:
        raise ValueError("inner products don't fit 64 bits")
    # bounded: a row for each of DIMENSIONS, and a sample
    found = by_dim.orderBy(F.desc("n"), "dim").limit(DIMENSIONS).collect()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    spaces = {}
    for r in found:
        mine = np.asarray([s["v"] for s in sample if s["dim"] == r["dim"]], "i8").reshape(-1, r["dim"])
        if len(mine):
            pivots = int(min(max((r["n"] / ANNULUS) ** 0.5, PIVOTS[0]), PIVOTS[1]))
            spaces[r["dim"]] = Space(choose_pivots(mine.astype("f8"), pivots), r["most"] * (1 + SLACK))
    shared = spark.sparkContext.broadcast(spaces)  # bounded: at most SAMPLE vectors

    def space_of(dim: int) -> Space:
        return shared.value.get(dim) or Space(np.zeros((1, dim)), most * (1 + SLACK))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            for dim, g in pdf.groupby("dim"):
                v = np.stack(g["v"].to_numpy()).astype("i8").reshape(len(g), dim)
                pivot, d = space_of(dim).keys(v)
                yield pa.RecordBatch.from_pydict(
                    {"vec_id": g["vec_id"].to_numpy(), "dim": pa.array([dim] * len(g), pa.int32()), "pivot": pivot.astype("i4"), "d": d,
                     "v": pa.array([x.tobytes() for x in v], pa.binary())}
                )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Annuli of consecutive rows, and the queries among them with their first bounds."""
        held: pd.DataFrame | None = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            while len(held) >= 2 * ANNULUS:
                yield blocks(held.iloc[:ANNULUS])
                held = held.iloc[ANNULUS:]
        if held is not None and len(held):
            yield blocks(held)

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (dim, pivot), g in pdf.groupby(["dim", "pivot"]):
            for at in range(0, len(g), ANNULUS):
                h = g.iloc[at : at + ANNULUS]
                ids = h["vec_id"].to_numpy().astype("i8")
                v = np.frombuffer(b"".join(h["v"]), "i8").reshape(len(h), dim)
                out.append((dim, pivot, h["d"].min(), h["d"].max(), ids.tobytes(), v.tobytes(), "annulus", None, int(ids[0])))
                mine = np.flatnonzero(ids % every == 0)
                for b in range(0, len(mine), QUERIES):
                    qs = mine[b : b + QUERIES]
                    s = scores(v[qs], v)
                    s[np.arange(len(qs)), qs] = NONE
                    kth = np.full(len(qs), NONE) if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    out.append((dim, pivot, 0.0, 0.0, ids[qs].tobytes(), v[qs].tobytes(), "queries", kth.tobytes(), int(ids[qs[0]])))
        return pd.DataFrame(out, columns=["dim", "pivot", "low", "high", "ids", "v", "kind", "radius", "block"])

    keyed = rows.mapInArrow(key, "vec_id long, dim int, pivot int, d double, v binary")
    index = materialize(
        keyed.repartitionByRange("dim", "pivot", "d", "vec_id").sortWithinPartitions("dim", "pivot", "d", "vec_id").mapInPandas(cut, INDEX), "annuli"
    )

    def reach(share: float):
        def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Each block of queries with each pivot: the distances to it that the ring touches."""
            for pdf in batches:
                for r in pdf.itertuples():
                    space = space_of(r.dim)
                    q, kth, done = np.frombuffer(r.q, "i8").reshape(-1, r.dim), np.frombuffer(r.kth, "i8"), np.frombuffer(r.done, "f8")
                    d, far = space.query_distances(q), space.radius(q, kth)
                    on = far > done  # others have stopped
                    if not on.any():
                        continue
                    d, ring = d[on], share * far[on]
                    lo, hi = (d - ring[:, None]).min(0), (d + ring[:, None]).max(0)
                    n = len(lo)
                    yield pd.DataFrame({"dim": [r.dim] * n, "pivot": range(n), "lo": lo, "hi": hi, "block": [r.block] * n,
                                        "qids": [r.qids] * n, "q": [r.q] * n, "kth": [r.kth] * n, "done": [r.done] * n})

        return reached

    def search(share: float):
        def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """The best of each annulus for each query that it is in the ring of; bounds rise with what the task has found."""
            known: dict[int, np.ndarray] = {}
            for pdf in batches:
                out = []
                for r in pdf.itertuples():
                    space = space_of(r.dim)
                    q, v = np.frombuffer(r.q, "i8").reshape(-1, r.dim), np.frombuffer(r.v, "i8").reshape(-1, r.dim)
                    qids, ids, kth, done = (np.frombuffer(x, k) for x, k in ((r.qids, "i8"), (r.ids, "i8"), (r.kth, "i8"), (r.done, "f8")))
                    tops = [known.get(int(i), np.empty(0, "i8")) for i in qids]
                    bound = np.asarray([max(t, top[-1]) if len(top) == k else t for t, top in zip(kth, tops, strict=True)], "i8")
                    d = space.query_distances(q)[:, r.pivot]
                    gap = np.maximum(0, np.maximum(d - r.high, r.low - d))
                    near = np.flatnonzero((gap > done) & (gap <= share * space.radius(q, kth)) & (gap <= space.radius(q, bound)))
                    if not len(near):
                        continue
                    s = scores(q[near], v)
                    for row, i in zip(s, near, strict=True):
                        at = np.flatnonzero((row >= bound[i]) & (ids != qids[i]))
                        at = at[best(row[at], ids[at], k)]
                        if len(at):
                            out.append(np.stack([np.full(len(at), qids[i]), ids[at], row[at]]))
                            known[int(qids[i])] = np.sort(np.concatenate([tops[i], row[at]]))[::-1][:k]
                    if len(known) > 50_000:
                        known.clear()
                if out:
                    a = np.hstack(out)
                    yield pd.DataFrame({"query_id": a[0], "vec_id": a[1], "score": a[2]})

        return searched

    def closer(share: float):
        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Blocks after a ring: how far each query is searched, and its bound by what was found."""
            for pdf in batches:
                rows_ = []
                for r in pdf.itertuples():
                    q, kth, done = np.frombuffer(r.q, "i8").reshape(-1, r.dim), np.frombuffer(r.kth, "i8"), np.frombuffer(r.done, "f8")
                    now = {x["query_id"]: x["kth"] for x in (r.found if r.found is not None else ())}
                    better = np.asarray([max(t, now.get(int(i), NONE)) for i, t in zip(np.frombuffer(r.qids, "i8"), kth, strict=True)], "i8")
                    rows_.append((r.dim, r.block, r.qids, r.q, better.tobytes(), np.maximum(done, share * space_of(r.dim).radius(q, kth)).tobytes()))
                yield pd.DataFrame(rows_, columns=["dim", "block", "qids", "q", "kth", "done"])

        return drawn

    ASKED = "dim int, block long, qids binary, q binary, kth binary, done binary"
    annuli = index.where("kind = 'annulus'").select("dim", "pivot", "low", "high", "ids", "v")

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(done=[np.full(len(x) // 8, -1.0).tobytes() for x in pdf["kth"]])[["dim", "block", "qids", "q", "kth", "done"]]

    asked = materialize(index.where("kind = 'queries'").select("dim", "block", F.col("ids").alias("qids"), F.col("v").alias("q"), F.col("radius").alias("kth")).mapInPandas(begun, ASKED), "queries")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = None
    for share in RINGS:
        touched = asked.mapInPandas(reach(share), "dim int, pivot int, lo double, hi double, block long, qids binary, q binary, kth binary, done binary")
        pairs = touched.join(annuli.hint("merge"), ["dim", "pivot"]).where("lo <= high AND hi >= low")
        hits = pairs.select("pivot", "dim", "low", "high", "ids", "v", "qids", "q", "kth", "done").mapInPandas(search(share), "query_id long, vec_id long, score long")
        hits = hits if top is None else hits.unionByName(top.drop("rank"))
        top_ = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if share == RINGS[-1]:
            return top_
        top = materialize(top_, "ring")
        bounds = top.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        # a block's queries are at most QUERIES, so is what is gathered for it
        mine = asked.select("block", F.explode(unpacked("qids")).alias("query_id"))
        found_ = mine.join(bounds, "query_id").groupBy("block").agg(F.collect_list(F.struct("query_id", "kth")).alias("found"))
        asked = materialize(asked.join(found_, "block", "left").mapInPandas(closer(share), ASKED), "queries")


def unpacked(packed: str) -> Column:
    """The 64-bit little-endian numbers of a binary column."""
    one = lambda i: F.conv(F.hex(F.reverse(F.substr(packed, 8 * i + 1, F.lit(8)))), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), (F.octet_length(packed) / 8).cast("int") - 1), one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
