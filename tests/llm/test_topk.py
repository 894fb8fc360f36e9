import numpy as np
import pytest

from terrafold.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, pivot int"


def brute(rows, k, every):
    vs = {}
    for i, e, *_ in rows:
        if e is not None and all(x is not None and np.isfinite(x) for x in e):
            vs[i] = [int(np.floor(64 * float(np.float32(x)))) for x in e]
    out = set()
    for q, v in vs.items():
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vs.items() if i != q and len(w) == len(v))
            out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize("spread", [0.02, 1.0, 1e6])
def test_against_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 40)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centers[i % 6] * (spread if spread > 1 else 1) + spread * rng.normal(size=8)], 1, 2, 3) for i in range(400)]
    rows += [(i, rows[0][1], 1, 2, 3) for i in range(400, 440)]  # ties
    rows += [(500, None, 1, 2, 3), (501, [1.0, None] + [0.0] * 6, 1, 2, 3), (520, [float("nan")] * 8, 1, 2, 3), (540, [0.0] * 8, 1, 2, 3), (560, [1.0], 1, 2, 3)]
    rows += [rows[20]]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), 5, 20)
    assert {tuple(r) for r in got.collect()} == brute(rows, 5, 20)


def test_few_and_no_rows(spark):
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0], 1, 1, 1), (1, [2.0], 1, 1, 1)], SCHEMA)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 128)]


def test_dimensions_beyond_those_with_pivots(spark, monkeypatch):
    """Rare dimensions have the origin as their pivot; results are whole all the same."""
    monkeypatch.setattr(topk, "DIMENSIONS", 2)
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % 7)], 1, 2, 3) for i in range(300)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), 3, 5)
    assert {tuple(r) for r in got.collect()} == brute(rows, 3, 5)
