from __future__ import annotations

import random

import numpy as np
import pytest

from orbitrace.operators import assignment
from orbitrace.operators.assignment import assign, optimal_assignment


def best_total(gain: dict) -> float:
    """The highest total over the right sides taken so far, left side by left side."""
    lefts = sorted({a for a, _ in gain})
    rights = {b: i for i, b in enumerate(sorted({b for _, b in gain}))}
    totals = {0: 0}
    for a in lefts:
        nxt = dict(totals)
        for used, total in totals.items():
            for (x, b), s in gain.items():
                if x == a and not used >> rights[b] & 1:
                    key = used | 1 << rights[b]
                    nxt[key] = max(nxt.get(key, 0), total + s)
        totals = nxt
    return max(totals.values())


def test_paths_find_the_best_total():
    rng = random.Random(0)
    for _ in range(150):
        gain = {(a, b): rng.choice([rng.randint(1, 4), rng.randint(1, 10**9)]) for a in range(rng.randint(1, 7)) for b in range(7) if rng.random() < 0.5}
        if gain:
            a, b, w = (np.array(x) for x in zip(*[(*k, s) for k, s in gain.items()], strict=True))
            got = assign(a, b, w)
            assert len(set(a[got])) == len(got) == len(set(b[got]))
            assert w[got].sum() == best_total(gain)


def strip_pairs(n: int, seed: int):
    """Left and right points on a strip, one component, pairs within a reach."""
    r = np.random.RandomState(seed)
    a, b = (np.c_[np.sort(r.rand(n) * n / 3), r.rand(n) * 3] for _ in range(2))
    d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    i, j = np.nonzero(d < 1.5)
    return i, j, 1.51 - d[i, j], a[i, 0]


@pytest.mark.parametrize("placed", [True, False])
def test_rounds_give_the_same_total_as_one_task(spark, placed, monkeypatch):
    monkeypatch.setattr(assignment, "RANGE_PAIRS", 1500)
    i, j, s, x = strip_pairs(400, 3)
    df = spark.createDataFrame([(f"l{a}", int(b), float(w), float(p)) for a, b, w, p in zip(i, j, s, x, strict=True)], "a string, b long, s double, p double").repartition(4)
    whole = np.rint(s * (assignment.STEPS / s.max())).astype(np.int64)
    want = s[assign(i, j, whole)].sum()
    got = optimal_assignment(df, "a", "b", "s", "p" if placed else None, local_pairs=300).collect()
    assert len({r.a for r in got}) == len({r.b for r in got}) == len(got)
    assert sum(r.s for r in got) == pytest.approx(want, abs=1e-6)
    given = {(f"l{a}", int(b)): float(w) for a, b, w in zip(i, j, s, strict=True)}
    assert all(given[r.a, r.b] == r.s for r in got)


def test_pairs_that_never_help_go(spark):
    rows = [(1, 1, 2.0), (1, 1, 3.0), (1, 2, 2.5), (2, 1, 2.9), (3, 3, -1.0), (4, 4, 0.0), (5, 5, float("nan")), (None, 6, 9.0), (6, None, 9.0), (7, 7, None), (8, 8, 1.0)]
    got = optimal_assignment(spark.createDataFrame(rows, "a long, b long, s double"), "a", "b", "s").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 2.5), (2, 1, 2.9), (8, 8, 1.0)]
    assert optimal_assignment(spark.createDataFrame([], "a long, b long, s double"), "a", "b", "s").collect() == []


def test_groups_need_no_rounds_for_components(spark, monkeypatch):
    from orbitrace.operators import graph

    steps = []
    settle = graph._next
    monkeypatch.setattr(graph, "_next", lambda old, new: steps.append(1) or settle(old, new))
    # a path in each frame, dealt so that no task sees a whole one
    rows = [(t, f"{t}:{i}", f"{t}:{j}", 1.0 + (i * 7 + j * 3 + t) % 5) for i in range(60) for t in range(4) for j in (i, i + 1)]
    df = spark.createDataFrame(rows, "t int, a string, b string, s double").repartition(8)
    got = optimal_assignment(df, "a", "b", "s", group="t").collect()
    assert len(steps) == 1
    total = sum(r.s for r in optimal_assignment(df, "a", "b", "s").collect())
    assert len({r.a for r in got}) == len(got) == len({r.b for r in got}) and sum(r.s for r in got) == pytest.approx(total)
