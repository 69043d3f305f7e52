"""Track and neighbour operators against small known cases and brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrace.functions import geometry as G
from orbitrace.functions import healpix as H
from orbitrace.operators import cells, clusters, fields, graph, lineage, msd, neighbors, regions, stats, surface, tracks


def track_rows(spark, rows):
    return spark.createDataFrame(rows, "track_id long, parent_track_id long, t int, x double, y double, z double, mean_fluo double")


def straight(spark, n=60, v=(1.0, 2.0, -0.5)):
    return track_rows(spark, [(1, -1, t, v[0] * t, v[1] * t, v[2] * t, float(t)) for t in range(n)])


def cloud(spark, frames=3, n=40, seed=2):
    rng = random.Random(seed)
    return track_rows(spark, [(i, -1, t, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(0, 100), rng.random()) for t in range(frames) for i in range(n)])


def test_straight_track(spark):
    k = straight(spark)
    a = msd.window_exponents(msd.sliding_msd(k, 20, 5, 6), (1, 6)).collect()
    assert len(a) == 9 and all(r.alpha == pytest.approx(2) and r.r2 == pytest.approx(1) for r in a)
    p = msd.sliding_persistence(k, 20, 5).collect()
    assert len(p) == 8 and all(r.mean_cos == pytest.approx(1) for r in p)
    vi = [r.vi for r in tracks.path_and_net_speed(k, 5).collect() if r.vi is not None]
    assert len(vi) == 56 and all(v == pytest.approx(1) for v in vi)


def test_still_track(spark):
    k = track_rows(spark, [(1, -1, t, 5.0, 5.0, 5.0, 1.0) for t in range(12)])
    out = tracks.preprocess_tracks(k, min_length=12).collect()
    assert all(r.mostly_stationary for r in out) and [r.is_stationary for r in sorted(out, key=lambda r: r.t)] == [False] + [True] * 11
    assert cells.velocity_alignment(k, 10.0).where("alignment IS NOT NULL").count() == 0
    assert tracks.preprocess_tracks(k, min_length=13).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 20])
def test_savgol_leaves_a_quadratic(spark, n):
    k = track_rows(spark, [(1, -1, t, 1.0 + 2 * t + 3 * t * t, float(t), 0.0, 0.0) for t in range(n)])
    for r in tracks.savgol(k, 5, 2).collect():
        assert r.x_s == pytest.approx(r.x) and r.y_s == pytest.approx(r.y)


def test_savgol_edges_match_polynomial_fits(spark):
    rng = np.random.RandomState(3)
    x = rng.rand(9)
    k = track_rows(spark, [(1, -1, t, float(v), 0.0, 0.0, 0.0) for t, v in enumerate(x)])
    got = [r.x_s for r in sorted(tracks.savgol(k, 5, 2, ("x",)).collect(), key=lambda r: r.t)]
    want = []
    for i in range(9):
        a = min(max(i - 2, 0), 4)
        want.append(np.polyval(np.polyfit(np.arange(5), x[a : a + 5], 2), i - a))
    assert got == pytest.approx(want)


def test_gaps_and_stitching(spark):
    rows = [(1, -1, t, float(t), 0.0, 0.0, 0.0) for t in [*range(5), *range(8, 13)]]
    seg = tracks.islands(track_rows(spark, rows))
    assert {r.t: r.segment for r in seg.collect()} == {t: int(t > 5) for _, _, t, *_ in rows}
    parts = lineage.track_ends(seg.withColumn("track_id", F.col("track_id") * 10 + F.col("segment")))
    assert {r.stitched for r in clusters.stitch_segments(parts, 3, 10.0).collect()} == {10}
    assert {r.stitched for r in clusters.stitch_segments(parts, 1, 10.0).collect()} == {10, 11}
    assert [(r.parent, r.child, r.gap) for r in lineage.close_gaps(seg.withColumn("track_id", F.col("track_id") * 10 + F.col("segment")), 4, 10.0).collect()] == [(10, 11, 4)]


def test_radius_pairs_match_brute_force(spark):
    k = cloud(spark)
    rows = k.collect()
    got = {(r.t, r.track_id, r.n_track_id) for r in neighbors.radius_pairs(k, k, 25.0).collect()}
    want = {(a.t, a.track_id, b.track_id) for a in rows for b in rows if a.t == b.t and math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)) <= 25}
    assert got == want


def test_copies_around_cells_are_not_broadcast(spark, tmp_path):
    """Neither frame is over the broadcast threshold before its rows are copied to the cells around their own."""
    path = str(tmp_path / "k")
    cloud(spark).write.parquet(path)
    k = spark.read.parquet(path)
    assert "Broadcast" not in neighbors.radius_pairs(k, k, 25.0)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small", [1000, 5])
def test_nearest_matches_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neighbors, "SMALL_FRAME", small)
    k = cloud(spark, 2, 30)
    rows = k.collect()
    got = {}
    for r in neighbors.nearest(k, k, 4, 5.0, "track_id", include_self=False).collect():
        got.setdefault((r.t, r.track_id), []).append((r.rank, r.n_track_id))
    for a in rows:
        near = sorted((math.dist((a.x, a.y, a.z), (b.x, b.y, b.z)), b.track_id) for b in rows if b.t == a.t and b.track_id != a.track_id)[:4]
        assert [i for _, i in sorted(got[a.t, a.track_id])] == [i for _, i in near]


def test_density_does_not_change_under_rotation(spark):
    k = cloud(spark)
    m = G.rotation_to_pole((1.0, 2.0, 3.0))
    turned = k.withColumns({a: sum((F.lit(m[i][j]) * F.col(b) for j, b in enumerate("xyz")), F.lit(7.0)) for i, a in enumerate("xyz")})
    get = lambda d: {(r.track_id, r.t): r.n_near for r in cells.local_density(d, 25.0).collect()}
    assert get(k) == get(turned)
    assert all(-1 - 1e-9 <= r.alignment <= 1 + 1e-9 for r in cells.velocity_alignment(k, 60.0).where("alignment IS NOT NULL").collect())


@pytest.mark.parametrize("nside", [1, 2, 3, 8, 16])
def test_pixels_round_trip(spark, nside):
    table = H.pixel_table(spark, nside)
    assert H.with_pixel(table, nside, "theta_pix", "phi_pix", "back").where("back <> pix").count() == 0
    assert table.count() == H.npix(nside)


def test_window_counts_sum_to_rows(spark):
    k = cloud(spark, 10, 20).withColumns({"theta": F.lit(1.0) + F.col("x") / 200, "phi": F.col("y") / 20, "time_min": F.col("t") * 1.0})
    c = fields.window_counts(k, 2, 1.0, 1.0)
    assert c.agg(F.sum("n")).first()[0] == 200


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in parent}
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_greedy_assignment(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(a, b, float(rng.randrange(6))) for a in range(12) for b in range(12) if rng.random() < 0.4]
    got = {(r.a, r.b) for r in clusters.greedy_assignment(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()}
    left, right, want = set(), set(), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    monkeypatch.setattr(clusters, "LOCAL_PAIRS", 20)
    rounds = {(r.a, r.b) for r in clusters.greedy_assignment(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()}
    assert got == rounds == want
    # equal scores may be taken in either order, so compare what greedy guarantees
    assert {s for a, b, s in pairs if (a, b) in got} <= {s for *_, s in pairs} and len({a for a, _ in got}) == len(got)
    assert sum(s for a, b, s in pairs if (a, b) in got) == sum(s for a, b, s in pairs if (a, b) in want)


def test_optimal_assignment(spark):
    import itertools

    rng = random.Random(8)
    pairs = [(a, b, rng.random()) for a in range(5) for b in range(5)]
    gain = {(a, b): s for a, b, s in pairs}
    out = clusters.optimal_assignment(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s").collect()
    assert sum(r.s for r in out) == pytest.approx(max(sum(gain[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))


def test_two_clumps_merge(spark):
    rows = []
    for t in range(8):
        for c in (0, 1):
            at = 0.6 * c if t < 5 else 0.05 * c
            rows += [(c * 10 + i, t, math.cos(at + i * 0.01), math.sin(at + i * 0.01), 0.0, 1.0) for i in range(6)]
    units = spark.createDataFrame(rows, "track_id long, t int, ux double, uy double, uz double, mean_fluo double")
    members, st = clusters.find_clusters(units, 0.05, 5)
    assert {r.t: r.n for r in st.groupBy("t").agg(F.count("*").alias("n")).collect()} == {t: 2 if t < 5 else 1 for t in range(8)}
    named, merges = clusters.link_clusters(clusters.cluster_pair_scores(members), st)
    assert named.select("chain_id").distinct().count() == 2
    m = merges.collect()
    assert len(m) == 1 and m[0].t == 5 and m[0].merged_into != m[0].merged_from
    assert clusters.chain_stats(named, st).agg(F.max("duration")).first()[0] == 8


def test_lineage(spark):
    k = track_rows(spark, [(i, p, t, 0.0, 0.0, 0.0, 0.0) for i, p, ts in ((1, -1, (0, 1)), (2, 1, (2, 3)), (3, 2, (4,)), (9, -1, (0,)), (8, 77, (1,))) for t in ts])
    got = {r.track_id: (r.root, r.span) for r in lineage.lineage_roots(k).collect()}
    assert got == {1: (1, 1), 2: (1, 3), 3: (1, 4), 9: (9, 0), 8: (8, 0)}
    flags = {r.track_id: (r.parent_flag, r.child_flag) for r in lineage.family_flags(k).collect()}
    assert flags == {1: (True, False), 2: (True, True), 3: (False, True), 9: (False, False), 8: (False, False)}


def test_linking_restores_tracks(spark):
    k = track_rows(spark, [(i, -1, t, 50.0 * i + t, 0.0, 0.0, 0.0) for i in range(4) for t in range(10)]).withColumnRenamed("track_id", "id")
    out = lineage.link_frames(k, 5.0).groupBy("track_id").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n")).collect()
    assert len(out) == 4 and all((r.ids, r.n) == (1, 10) for r in out)


def test_fusing(spark):
    k = track_rows(spark, [(i, -1, t, 100.0 * (i == 3) + t, float(i == 2), 0.0, 0.0) for i in (1, 2, 3) for t in range(6)])
    out = lineage.fuse_duplicates(k, 3.0).collect()
    assert {r.track_id for r in out} == {1, 3} and all(r.y == 0.5 for r in out if r.track_id == 1)


def test_fusing_takes_the_median_over_all_common_frames(spark):
    # near in 6 of 60 common frames and far in the others: two cells, whose paths cross
    k = track_rows(spark, [(i, -1, t, float(t) + (500.0 if i == 2 and t >= 6 else 0.0), 0.0, 0.0, 0.0) for i in (1, 2) for t in range(60)])
    assert {r.track_id for r in lineage.fuse_duplicates(k, 5.0).collect()} == {1, 2}
    # near in 31 of 60: one cell
    k = track_rows(spark, [(i, -1, t, float(t) + (500.0 if i == 2 and t >= 31 else 0.0), 0.0, 0.0, 0.0) for i in (1, 2) for t in range(60)])
    assert {r.track_id for r in lineage.fuse_duplicates(k, 5.0).collect()} == {1}
    # four common frames are too few
    k = track_rows(spark, [(i, -1, t, float(t), 0.0, 0.0, 0.0) for i in (1, 2) for t in range(4)])
    assert {r.track_id for r in lineage.fuse_duplicates(k, 5.0).collect()} == {1, 2}


def test_exact_quantiles_and_ids(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANK_BLOCK", 7)
    rng = random.Random(4)
    values = [float(rng.randrange(60)) for _ in range(211)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    shares = [0.0, 0.1, 0.37, 0.5, 0.95, 1.0]
    assert stats.exact_quantiles(df, "v", shares) == pytest.approx(np.quantile(values, shares).tolist())
    assert stats.exact_quantiles(df.where("v IS NULL"), "v", shares) == []
    assert stats.quantile_bins(df.where("v IS NULL"), "v", 4, "v").count() == 0
    ids = {v: k for k, v in enumerate(sorted(set(values)))}
    assert all(r.v_id == ids[r.v] for r in stats.category_ids(df, "v").collect()) and stats.category_ids(df, "v").count() == 211


def test_components_of_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK_EDGES", 5)
    rng = random.Random(8)
    edges = [(t, rng.randrange(30), rng.randrange(30)) for t in range(4) for _ in range(20)]
    df = spark.createDataFrame(edges, "t int, a long, b long").select(F.struct("t", "a").alias("src"), F.struct("t", F.col("b").alias("a")).alias("dst"))
    got = {(r.node.t, r.node.a): (r.component.t, r.component.a) for r in graph.connected_components(df, block="u.t").collect()}
    label = {(t, x): (t, x) for t, a, b in edges for x in (a, b)}
    for _ in range(40):
        for t, a, b in edges:
            label[t, a] = label[t, b] = min(label[t, a], label[t, b])
    assert got == label
    text = spark.createDataFrame([("b", "a"), ("é", "b"), ("q", "q"), (None, "a")], "src string, dst string")
    assert {r.node: r.component for r in graph.connected_components(text).collect()} == {"a": "a", "b": "a", "é": "a", "q": "q"}


def test_joined_runs(spark):
    cols = "track_id long, parent_track_id long, t int, x double"
    a = spark.createDataFrame([(1, -1, t, 0.0) for t in range(3)] + [(2, -1, t, 9.0) for t in range(3)], cols)
    b = spark.createDataFrame([(5, -1, t, 0.0) for t in range(3)] + [(6, 5, 2, 4.0)], cols)
    voxel = "z int, y int, x int, label long"
    out = lineage.join_runs(a, b, spark.createDataFrame([(0, 0, i, 1) for i in range(4)], voxel), spark.createDataFrame([(0, 0, i, 5) for i in range(3)], voxel), 2)
    got = sorted((r.track_id, r.parent_track_id, r.t) for r in out.collect())
    assert got == [(1, -1, 0), (1, -1, 1), (1, -1, 2), (1, -1, 3), (1, -1, 4), (2, -1, 0), (2, -1, 1), (2, -1, 2), (9, 1, 4)]


def test_sphere_fits(spark):
    rng = np.random.RandomState(0)
    rows = []
    for t, (c, r) in enumerate((((1.0, 2.0, 3.0), 10.0), ((-5.0, 0.0, 4.0), 25.0))):
        d = rng.randn(200, 3)
        p = np.array(c) + r * d / np.linalg.norm(d, axis=1)[:, None]
        rows += [(t, *map(float, x)) for x in p]
    df = spark.createDataFrame(rows, "t int, x double, y double, z double")
    noise = spark.createDataFrame([(0, *map(float, x)) for x in rng.uniform(-40, 40, (10, 3))], df.schema)
    for fit in (surface.algebraic_sphere(df), surface.fit_sphere(df, rounds=3), surface.refit_inliers(df.unionByName(noise), 2.0, rounds=8)):
        got = {r.t: (r.center_x, r.center_y, r.center_z, r.radius) for r in fit.collect()}
        assert got[0] == pytest.approx((1, 2, 3, 10), abs=1e-2) and got[1] == pytest.approx((-5, 0, 4, 25), abs=1e-2)
    fixed = {r.t: r.radius for r in surface.fit_sphere(df, rounds=3, fixed_radius=12.0).collect()}
    assert fixed == {0: 12.0, 1: 12.0}


def test_rotation_on_a_sphere(spark):
    """Rigid rotation about z: no divergence, and at the pole a curl of minus twice the rate in the left-handed basis."""
    rng = np.random.RandomState(1)
    w, rad, rows = 0.02, 100.0, []
    for i in range(900):
        d = rng.randn(3)
        d /= np.linalg.norm(d)
        p, v = rad * d, w * np.array([-d[1], d[0], 0.0]) * rad
        theta, phi = math.acos(d[2]), math.atan2(d[1], d[0]) % (2 * math.pi)
        rows.append((i, 0, 1.0, 0.0, *map(float, p), *map(float, v), *map(float, d), theta, phi, 1.0))
    s = spark.createDataFrame(rows, "track_id long, t int, dt double, mid_time double, mx double, my double, mz double, vx double, vy double, vz double, ux double, uy double, uz double, theta double, phi double, mid_fluo double")
    f = fields.vector_field(s, 2, 0.4, rad, 10.0, 10.0).collect()
    assert len(f) > 30 and all(abs(r.divergence) < 0.2 * w for r in f)
    assert all(r.curl == pytest.approx(-2 * w, rel=0.25) for r in f if r.pix < 4)


def test_regions(spark):
    rows = [(0, z, y, x, 0, 1, float(z)) for z in range(2) for y in range(2) for x in range(2)] + [(0, 9, 9, x, 0, 2, 5.0) for x in range(4)]
    v = spark.createDataFrame(rows, "t int, z int, y int, x int, channel int, label long, intensity double")
    assert [(r.label, r.volume) for r in regions.volume_filter(v, 5).collect()] == [(1, 8)]
    f = {r.label: r for r in regions.region_features(v).collect()}
    assert f[1].extent == 1.0 and f[1].elongation == pytest.approx(1) and f[2].elongation is None and f[2].bbox_x == 4
    m = np.array([[4.0, 1, 0.5], [1, 3, 0.2], [0.5, 0.2, 2]])
    e = regions.with_eigenvalues(spark.createDataFrame([(4.0, 3.0, 2.0, 1.0, 0.5, 0.2)], "vx double, vy double, vz double, cxy double, cxz double, cyz double")).first()
    assert (e.eig_a, e.eig_b, e.eig_c) == pytest.approx(tuple(sorted(np.linalg.eigvalsh(m), reverse=True)))
    shade = spark.createDataFrame([(0, 5, y, x, 0, 1, 1.0) for y in range(3) for x in range(3)] + [(0, 2, y, x, 0, 2, 1.0) for y in range(2) for x in range(2)], v.schema)
    assert [r.label for r in regions.shadowed_labels(shade, 0.4).collect()] == [1]


def test_sampling_and_bootstrap(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 100, 50.0).otherwise(1.0))
    drawn = stats.weighted_sample(df, 100, "w", ["id"])
    assert drawn.count() == 100 and drawn.where("id < 100").count() > 50
    b = stats.bootstrap_mean(df.withColumn("v", F.col("id") % 10), "v", "id", 100).first()
    assert b["mean"] == pytest.approx(4.5) and b.low < 4.5 < b.high and b.error == pytest.approx(2.87 / math.sqrt(2000), rel=0.5)


def test_nearest_reaches_from_a_dense_clump_to_far_rows(spark, monkeypatch):
    rng = random.Random(2)
    points = [(i, 0, rng.gauss(0, 0.01), rng.gauss(0, 0.01), 0.0) for i in range(400)] + [(1000 + i, 0, 50.0 * i, 7.0 * i * i, 3.0) for i in range(1, 9)]
    odd = [(2000, 0, None, 0.0, 0.0), (2001, 0, float("nan"), 0.0, 0.0), (2002, 0, float("inf"), 0.0, 0.0), (2003, None, 0.0, 0.0, 0.0), (7, 1, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(points + odd, "track_id long, t int, x double, y double, z double")
    monkeypatch.setattr(neighbors, "SMALL_FRAME", 0)
    for own in (True, False):
        got = {}
        for r in neighbors.nearest(df, df, 3, 10.0, "track_id", include_self=own).collect():
            got.setdefault((r.t, r.track_id), {})[r["rank"]] = r.n_track_id
        want = {}
        for i, t, *p in points:
            near = sorted((math.dist(p, q), j) for j, _, *q in points if own or j != i)[:3]
            want[t, i] = {k + 1: j for k, (_, j) in enumerate(near)}
        if own:
            want[1, 7] = {1: 7}
        assert got == want
