"""Material response, trends and bins against known cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from orbitrace.operators import materials as P
from tests.test_tracks import cloud, track_rows


def test_affine_motion_has_no_residual(spark):
    rng = np.random.RandomState(4)
    p = rng.rand(20, 3) * 50
    m = np.eye(3) + 0.1 * rng.rand(3, 3)
    rows = [(i, -1, t, *map(float, q), 0.0) for t, qs in enumerate((p, p @ m.T + 3)) for i, q in enumerate(qs)]
    out = P.d2min(track_rows(spark, rows), 8, 20.0).where("t = 0").collect()
    assert len(out) == 20 and all(r.d2min == pytest.approx(0, abs=1e-6) for r in out)


def test_residual_matches_least_squares(spark):
    k = cloud(spark, 2, 12)
    at = {(r.t, r.track_id): np.array([r.x, r.y, r.z]) for r in k.collect()}
    for r in P.d2min(k, 6, 30.0).where("t = 0").collect():
        near = sorted((np.linalg.norm(at[0, j] - at[0, r.track_id]), j) for j in range(12) if j != r.track_id)[:6]
        a = np.array([at[0, j] - at[0, r.track_id] for _, j in near])
        b = np.array([at[1, j] - at[1, r.track_id] for _, j in near])
        fit = np.linalg.lstsq(a, b, rcond=None)[0]
        assert r.d2min == pytest.approx(((b - a @ fit) ** 2).sum() / 6, rel=1e-6)


def test_common_motion_is_no_cage_motion(spark):
    base = [(r.track_id, r.x, r.y, r.z) for r in cloud(spark, 1, 15).collect()]
    rows = [(i, -1, t, x + 3.0 * t, y - t, z, 0.0) for t in range(4) for i, x, y, z in base]
    out = {r.lag: r.msd for r in P.cage_relative_msd(track_rows(spark, rows), 4, 30.0, (1, 2)).collect()}
    assert out == {1: pytest.approx(0, abs=1e-9), 2: pytest.approx(0, abs=1e-9)}


def test_trend_keeps_a_line(spark):
    rows = [(1, t, 0.001 if t % 9 == 4 else 5.0 + 2 * t) for t in range(40)]
    out = P.lowess_threshold(spark.createDataFrame(rows, "g int, t int, v double"), "g", "t", "v").collect()
    assert len(out) == 40 and all(r.trend == pytest.approx(5 + 2 * r.t) for r in out)


def test_border_vertices(spark):
    patches = spark.createDataFrame([(0, v, t) for v, t in ((1, 7), (2, 7), (3, 8), (4, 8), (5, 8))], "t int, vertex_id long, track_id long")
    faces = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [3, 4, 5])], "t int, face_id long, corners array<long>")
    assert {r.vertex_id for r in P.border_vertices(faces, patches).collect()} == {1, 2, 3}


def test_sliding_trend_is_that_of_all_distances(spark, monkeypatch):
    """Against the same fits with the distances of every two values, window by window and all at once."""
    rng = np.random.RandomState(3)
    rows = [(g, int(t), float(40 + 10 * math.sin(t / 9) + rng.randn() + (60 if rng.rand() < 0.05 else 0))) for g in (0, 1) for t in np.unique(rng.randint(0, 300, 150))]

    def dense(x, y, share=0.3, robust=3):
        n = min(len(x), max(2, int(share * len(x) + 1e-10)))
        d = np.abs(x[:, None] - x[None])
        h = np.maximum(np.sort(d, axis=1)[:, n - 1], 1e-12) * (1 + 1e-9)
        near, trust = np.clip(1 - (d / h[:, None]) ** 3, 0, None) ** 3, np.ones(len(x))
        for _ in range(robust + 1):
            fit = np.array([np.polynomial.polynomial.polyfit(x - v, y, 1, w=np.sqrt(near[i] * trust))[0] for i, v in enumerate(x)])
            off = np.abs(y - fit)
            trust = np.clip(1 - (off / (6 * np.median(off))) ** 2, 0, None) ** 2
        return fit

    for size in (7, 64):
        monkeypatch.setattr(P, "FIT_ROWS", size)
        out = P.lowess_threshold(spark.createDataFrame(rows, "g int, t int, v double"), "g", "t", "v").collect()
        for g in (0, 1):
            x, y = (np.array([r[k] for r in rows if r[0] == g], float) for k in (1, 2))
            got = {r.t: r.trend for r in out if r.g == g}
            assert np.allclose([got[int(t)] for t in x], dense(x, y), atol=1e-6)


def test_neighbours_leave_a_task_as_one_row_a_cell(spark, monkeypatch):
    k = cloud(spark, 3, 15)
    counts = []
    nearest = P.nearest
    monkeypatch.setattr(P, "nearest", lambda *a, **b: counts.append(nearest(*a, **b)) or counts[-1])
    at = {(r.t, r.track_id): np.array([r.x, r.y, r.z]) for r in k.collect() if (r.t, r.track_id) != (1, 4)}
    gone = k.where("NOT (t = 1 AND track_id = 4)")
    want, lags = {}, {}
    for (t, i), p in at.items():
        near = [j for _, j in sorted((np.linalg.norm(q - p), j) for (s, j), q in at.items() if s == t and j != i)[:6]]
        near = [j for j in near if (t + 1, j) in at]
        if (t + 1, i) in at and near:
            a, b = (np.array([at[s, j] - at[s, i] for j in near]) for s in (t, t + 1))
            want[i, t] = pytest.approx(((b - a @ np.linalg.lstsq(a, b, rcond=None)[0]) ** 2).sum() / len(near), rel=1e-6)
            if len(near) >= 3:
                lags[i, t] = np.sum((at[t + 1, i] - p - np.mean([at[t + 1, j] - at[t, j] for j in near], axis=0)) ** 2)
    assert {(r.track_id, r.t): r.d2min for r in P.d2min(gone, 6, 30.0).collect()} == want and len(want) == 28
    out = {r.lag: (r.msd, r.n) for r in P.cage_relative_msd(gone, 6, 30.0, (1,)).collect()}
    assert out == {1: (pytest.approx(np.mean(list(lags.values()))), len(lags))}
    assert [c.count() for c in counts] == [len(at), len(at)]
