"""Near rows met in blocks against brute force, over sparse and crowded places and negative coordinates."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrace.operators import blocks, clusters


@pytest.fixture(scope="module")
def crowd(spark):
    rng = random.Random(5)
    rows = [(i, t, rng.gauss(0, 8 if i % 2 else 120), rng.gauss(-50, 8 if i % 2 else 120), rng.gauss(0, 20), None if i % 7 == 0 else rng.random()) for t in range(2) for i in range(300)]
    rows += [(300 + i, 0, 10.0 * i, 0.0, 0.0, 1.0) for i in range(20)] + [(900, 0, None, 0.0, 0.0, 1.0), (901, None, 0.0, 0.0, 0.0, 1.0), (902, 1, float("nan"), 0.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "track_id long, t int, x double, y double, z double, v double").cache()


def near_of(df, radius):
    rows = [r for r in df.collect() if r.t is not None and r.x is not None and not math.isnan(r.x)]
    dist = lambda a, b: math.sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))
    return {(a.t, a.track_id): sorted((dist(a, b), b.track_id, b.v) for b in rows if b.t == a.t and dist(a, b) <= radius) for a in rows}


@pytest.mark.parametrize("radius", [10.0, 60.0])
def test_sums_and_nearest(spark, crowd, radius):
    want = near_of(crowd, radius)
    got = {(r.t, r.track_id): r for r in blocks.near_sums(crowd, crowd, radius, values=["v"], measure=np.square).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    for k, r in got.items():
        held = [v for _, _, v in want[k] if v is not None]
        assert r.n_v == len(held) and math.isclose(r.s_v, sum(held), abs_tol=1e-9)
        assert math.isclose(r.s_distance, sum(d * d for d, _, _ in want[k]), rel_tol=1e-9, abs_tol=1e-9)
    some = {(r.t, r.track_id): min(r.n, 6) for r in blocks.near_sums(crowd, crowd, radius, enough=6).collect()}
    assert some == {k: min(len(v), 6) for k, v in want.items()}
    odd = crowd.where("track_id % 3 = 1")
    first = {}
    for r in blocks.near_first(crowd, odd, 2, radius, include_self=False).collect():
        first.setdefault((r.t, r.track_id), {})[r["rank"]] = r.n_track_id
    other = {k: [i for _, i, _ in v if i % 3 == 1 and i != k[1]][:2] for k, v in want.items()}
    assert {k: [v[1 + i] for i in range(len(v))] for k, v in first.items()} == {k: v for k, v in other.items() if v}


def test_links_of_blocks_have_the_components_of_all_pairs(spark, crowd):
    want, links = near_of(crowd, 10.0), blocks.near_links(crowd, 10.0).collect()
    label = {k: k for k in want}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, v in want.items():
        for _, i, _ in v:
            a, b = root(k), root((k[0], i))
            label[max(a, b)] = min(a, b)
    got = clusters.frame_components(blocks.near_links(crowd, 10.0), least=1).collect()
    assert {(r.t, r.track_id): r.component for r in got} == {k: root(k)[1] for k in want}
    # a row for every copy, not for every pair
    assert len(links) < sum(len(v) for v in want.values()) / 2


def test_correlation_of_lists_of_different_lengths(spark, crowd):
    rng = random.Random(3)
    series = {i: [1.0] * 4 if i % 11 == 0 else [rng.random() for _ in range(i % 5)] for i in range(1000)}
    lists = spark.createDataFrame(list(series.items()), "track_id long, s array<double>")
    want, total = near_of(crowd, 30.0), {}
    for k, v in want.items():
        got = []
        for _, i, _ in v:
            n = min(len(series[k[1]]), len(series[i]))
            a, b = series[k[1]][:n], series[i][:n]
            if i != k[1] and n >= 2 and max(a) > min(a) and max(b) > min(b):
                got.append(np.corrcoef(a, b)[0, 1])
        if got:
            total[k] = sum(got) / len(got)
    rows = blocks.near_correlation(crowd.join(lists, "track_id"), "s", 4, 2, 30.0).where(F.col("correlation").isNotNull()).collect()
    got = {(r.t, r.track_id): r.correlation for r in rows}
    assert got.keys() == total.keys() and all(math.isclose(got[k], total[k], abs_tol=1e-9) for k in got)


def test_nearest_with_keys_of_two_columns_and_ties(spark):
    rows = [(0, (1, t), float(t // 2), 0.0, 0.0) for t in range(6)]
    df = spark.createDataFrame(rows, "t int, step struct<a: long, b: long>, x double, y double, z double")
    got = sorted((r.step.b, r["rank"], r.n_step.b) for r in blocks.near_first(df, df, 2, 1.0, key="step", include_self=False).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 3), (2, 2, 0), (3, 1, 2), (3, 2, 0), (4, 1, 5), (4, 2, 2), (5, 1, 4), (5, 2, 2)]
