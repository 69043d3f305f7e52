"""Fields, surfaces, cluster tracking and statistics against brute force or known answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrace.functions import geometry as G
from orbitrace.functions import healpix as H
from orbitrace.operators import clusters, fields, materials, regions, stats, surface
from orbitrace.sources import tables

STEPS = (
    "track_id long, t int, dt double, mid_time double, x0 double, y0 double, z0 double, x double, y double, z double, mx double, my double, mz double, "
    "vx double, vy double, vz double, ux double, uy double, uz double, theta double, phi double, radius double, mid_fluo double"
)


def step_rows(spark, n=60, frames=3, seed=1, dts=(1.0,), radius=10.0):
    rng = np.random.RandomState(seed)
    rows = []
    for i in range(n):
        for t in range(frames):
            d = rng.randn(3) * [1, 1, 0.5] + [1.5, 0, 0]
            a = radius * d / np.linalg.norm(d)
            b = a + rng.randn(3)
            dt = float(dts[(i + t) % len(dts)])
            m, v = (a + b) / 2, (b - a) / dt
            r = float(np.linalg.norm(m))
            rows.append((i, t, dt, t + 0.5, *map(float, (*a, *b, *m, *v, *(m / r))), math.acos(m[2] / r), math.atan2(m[1], m[0]) % (2 * math.pi), r, float(rng.rand())))
    return spark.createDataFrame(rows, STEPS), rows


def weighted(steps, nside, sigma, least):
    """(step number, pixel, weight) of all steps over all pixels, as every step is in the only window."""
    theta, phi = pixel_angles(nside)
    c = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], axis=1)
    out = []
    for k, r in enumerate(steps):
        angle = np.arccos(np.clip(c @ np.array(r[16:19]), -1, 1))
        w = np.exp(-0.5 * (angle / sigma) ** 2)
        out += [(k, int(p), float(w[p])) for p in np.flatnonzero((angle <= 2 * sigma) & (w > least))]
    return out


_ANGLES = {}


def pixel_angles(nside):
    return _ANGLES[nside]


@pytest.fixture(scope="module", autouse=True)
def angles(spark):
    for nside in (1, 2, 4):
        rows = H.pixel_table(spark, nside).orderBy("pix").collect()
        assert [r.pix for r in rows] == list(range(12 * nside * nside))
        _ANGLES[nside] = np.array([r.theta_pix for r in rows]), np.array([r.phi_pix for r in rows])


@pytest.mark.parametrize("nside,radius", [(1, 0.5), (2, 0.4), (4, 0.3), (2, 4.0)])
def test_pixel_neighbours_match_brute_force(spark, nside, radius):
    theta, phi = pixel_angles(nside)
    v = np.stack([np.sin(theta) * np.cos(phi), np.sin(theta) * np.sin(phi), np.cos(theta)], axis=1)
    angle = np.arccos(np.clip(v @ v.T, -1, 1))
    got = {(r.pix, r.near): r.angle for r in H.pixel_neighbors(spark, nside, radius).collect()}
    assert set(got) == {(int(i), int(j)) for i, j in zip(*np.nonzero((angle <= radius) | np.eye(len(v), dtype=bool)), strict=True)}
    assert all(a == pytest.approx(angle[k], abs=1e-6) for k, a in got.items())


def test_entropy_and_alignment_over_blocks(spark, monkeypatch):
    df, rows = step_rows(spark)
    monkeypatch.setattr(fields, "PAIR_ROWS", 7)
    want, align = {}, {}
    by_pix = {}
    for k, p, w in weighted(rows, 1, 0.6, 1e-2):
        by_pix.setdefault(p, []).append((np.array(rows[k][13:16]) / np.linalg.norm(rows[k][13:16]), w))
    for p, items in by_pix.items():
        h, w = np.array([a for a, _ in items]), np.array([b for _, b in items])
        i, j = np.triu_indices(len(h), 1)
        if len(i):
            cos, pw = np.clip((h @ h.T)[i, j], -1, 1), w[i] * w[j]
            q = np.histogram(np.arccos(cos), 36, (0, math.pi), weights=pw)[0] / pw.sum()
            want[p], align[p] = -np.sum(q[q > 0] * np.log(q[q > 0])) / math.log(36), np.sum(pw * cos) / pw.sum()
    got = {r.pix: r.entropy for r in fields.misalignment_entropy(df, 1, 0.6, 1000.0, 1000.0).where("t_idx = 0").collect()}
    assert got == pytest.approx(want)
    assert {r.pix: r.alignment for r in fields.pair_alignment(df, 1, 0.6, 1000.0, 1000.0).where("t_idx = 0").collect()} == pytest.approx(align)
    assert fields.misalignment_entropy(df.where("false"), 1, 0.6).count() == 0


def test_material_fields_match_brute_force(spark):
    df, rows = step_rows(spark, n=40, dts=(1.0, 1.0, 1.0, 20.0))
    want = {}
    by_pix = {}
    for k, p, w in weighted(rows, 1, 0.6, 1e-2):
        by_pix.setdefault(p, []).append((k, w))
    for p, items in by_pix.items():
        if len(items) < 3:
            continue
        a, b, dt = (np.array([rows[k][s] for k, _ in items]) for s in (slice(4, 7), slice(7, 10), 2))
        w, rel, d2 = np.array([x for _, x in items]), [], []
        for i in range(len(items)):
            near = [j for _, j in sorted((math.dist(a[i], a[j]), (rows[items[j][0]][0], rows[items[j][0]][1]), j)[::2] for j in range(len(items)) if j != i)][:5]
            rel.append(np.sum((b[i] - a[i] - np.mean(b[near] - a[near], axis=0)) ** 2))
            r0, r1 = a[near] - a[i], b[near] - b[i]
            fit = np.linalg.lstsq(r0, r1, rcond=None)[0]
            d2.append(np.mean(np.sum((r1 - r0 @ fit) ** 2, axis=1)) if len(near) >= 3 else np.nan)
        rel, d2, short, long = np.array(rel), np.array(d2), dt <= 3, dt >= 12
        ok = np.isfinite(d2)
        want[p] = (
            math.log(rel[long].mean() / rel[short].mean()) / math.log(4) if short.any() and long.any() else None,
            *(np.average(d2[m & ok], weights=w[m & ok]) if (m & ok).any() else None for m in (short, long)),
        )
    got = {r.pix: (r.cmsd_alpha, r.d2min_short, r.d2min_long) for r in materials.material_fields(df, 1, 0.6, 5, 1000.0, 1000.0).where("t_idx = 0").collect()}
    assert got.keys() == want.keys()
    for p, values in want.items():
        assert [x is None for x in got[p]] == [x is None for x in values]
        assert [x for x in got[p] if x is not None] == pytest.approx([x for x in values if x is not None], rel=1e-6, abs=1e-9)


def test_flat_cages_take_the_map_of_least_norm(spark):
    rng = np.random.RandomState(3)
    a = np.column_stack([rng.randn(6, 2), np.zeros(6)])  # all neighbours in a plane
    b = rng.randn(6, 3)
    pairs = spark.createDataFrame([(0, *map(float, (*p, *q))) for p, q in zip(a, b, strict=True)], "k int, ax double, ay double, az double, bx double, by double, bz double")
    sums = materials._residual(pairs, ["k"], 3)
    assert sums.first().d2min is None
    got = materials._flat_residual(sums.drop("d2min"), ["k"]).first().d2min
    assert got == pytest.approx(np.mean(np.sum((b - a @ np.linalg.lstsq(a, b, rcond=None)[0]) ** 2, axis=1)))


def test_msd_exponent_of_a_straight_track(spark):
    rows = [(i, float(t), 0.01 * t, 0.0, 10.0, 0.001 * t, 0.5 * i) for i in range(2) for t in range(12)]
    df = spark.createDataFrame(rows, "track_id long, time_min double, x double, y double, z double, theta double, phi double")
    out = fields.pixel_msd_exponent(df, 1, 1000.0, 1000.0).collect()
    assert out and all(r.msd_alpha == pytest.approx(2) and r.msd_value == pytest.approx(0.0016) for r in out)


def test_laplacian_and_gaussian_smoothing(spark):
    rng = random.Random(2)
    values = {p: rng.random() for p in range(48) if p % 5}
    df = spark.createDataFrame([(0, p, v) for p, v in values.items()], "t int, pix long, value double")
    reach = 1.5 * math.sqrt(4 * math.pi / 48)
    near = {}
    for r in H.pixel_neighbors(spark, 2, reach).collect():
        near.setdefault(r.pix, []).append((r.near, r.angle))
    f = dict(values)
    for _ in range(6):
        f = {p: (values[p] + 0.5 * sum(f[q] for q, _ in near[p] if q != p and q in f)) / (1 + 0.5 * sum(q != p and q in f for q, _ in near[p])) for p in values}
    assert {r.pix: r.value_smooth for r in fields.laplacian_smooth(df, 2, 0.5, 6).collect()} == pytest.approx(f)
    wide = {}
    for r in H.pixel_neighbors(spark, 2, 1.2).collect():
        wide.setdefault(r.pix, []).append((round(r.angle, 6), r.near, r.angle))
    want = {}
    for p, items in wide.items():
        some = [(math.exp(-0.5 * (a / 0.4) ** 2), values[q]) for _, q, a in sorted(items)[:25] if q in values]
        if some:
            want[p] = sum(w * v for w, v in some) / sum(w for w, _ in some)
    assert {r.pix: r.value_smooth for r in fields.smooth_field(df, 2, 0.4).collect()} == pytest.approx(want)


def test_harmonic_surface_of_a_tilted_sphere(spark):
    rng = np.random.RandomState(5)
    theta, phi = np.arccos(rng.uniform(-1, 1, 800)), rng.uniform(0, 2 * math.pi, 800)
    r = 10 + 0.8 * np.cos(theta)
    df = spark.createDataFrame([(0, *map(float, x)) for x in zip(theta, phi, r, strict=True)], "t int, theta double, phi double, r double")
    out = surface.evaluate_harmonics(df, surface.harmonic_surface(df, 4, 2), 2).collect()
    assert np.mean([abs(x.r_fit - (10 + 0.8 * math.cos(x.theta))) for x in out]) < 0.05


def test_surface_distance_and_mask_quality(spark):
    rng = np.random.RandomState(7)
    d = rng.randn(120, 3)
    p = 50.0 * d / np.linalg.norm(d, axis=1)[:, None]
    rows = [(0, i, *map(float, x)) for i, x in enumerate(p)] + [(0, 900, 0.0, 0.0, 80.0)]
    kept = surface.surface_distance_filter(spark.createDataFrame(rows, "t int, track_id long, x double, y double, z double"), 5.0)
    assert {r.track_id for r in kept.collect()} == set(range(120))
    box = [(0, 1, z, y, x, 1.0) for z in range(3) for y in range(4) for x in range(4)] + [(0, 2, 5, 20, 20, 1.0)] + [(0, 3, z, y + 30, x, 1.0) for z in range(3) for y in range(4) for x in range(4)]
    voxels = spark.createDataFrame([(t, label, float(z), y, x, v) for t, label, z, y, x, v in box], "t int, label long, z double, y long, x long, intensity double").withColumn("channel", F.lit(0))
    assert sorted((r.label, r.new_label) for r in regions.mask_quality(voxels, 5, 0.5).collect()) == [(1, 1), (3, 2)]
    assert sorted(r.label for r in regions.mask_quality(voxels, None, None).collect()) == [1, 2, 3]


def moving_clumps():
    """Cells of four clumps on the unit sphere: 0 and 1 run into each other, 2 rests and goes missing, 3 moves steadily."""
    rng = np.random.RandomState(4)
    jitter = rng.uniform(-0.03, 0.03, (4, 7, 2))
    rows = []
    for t in range(12):
        centres = {0: (0.3 + 0.03 * t, 0.0), 1: (0.9 - 0.03 * t, 0.0), 3: (1.5, 1.0 + 0.05 * t)}
        if t not in (5, 6):
            centres[2] = (1.5, 4.0)
        for c, (theta, phi) in centres.items():
            for i in range(7):
                a, b = theta + jitter[c, i, 0], phi + jitter[c, i, 1] / math.sin(theta)
                rows.append((c * 10 + i, t, math.sin(a) * math.cos(b), math.sin(a) * math.sin(b), math.cos(a), float(c)))
    return rows


def brute_tracking(stats_rows, member_rows, angle, max_angle, least, w):
    """Frame by frame, over plain dictionaries."""
    by_t, cells = {}, {}
    for r in stats_rows:
        by_t.setdefault(r.t, {})[r.cluster_id] = r
    for r in member_rows:
        cells.setdefault((r.t, r.cluster_id), []).append((r.ux, r.uy, r.uz))
    feat = lambda r: np.array([math.log1p(r.size), r.fluo_mean, r.deg_mean, r.nn_dist_mean])
    centre = lambda r: np.array([r.cx, r.cy, r.cz])
    chains, merges, active = {}, set(), {}
    for t in range(min(by_t), max(by_t) + 1):
        now, cand = {}, []
        for a, (chain, before) in active.items():
            pa = by_t[t - 1][a]
            ahead = centre(pa)
            if before is not None:
                axis = np.cross(before, ahead)
                if np.linalg.norm(axis) > 1e-12:
                    ahead = 2 * (before @ ahead) * ahead - before
            for b, pb in by_t.get(t, {}).items():
                if math.acos(min(1, centre(pa) @ centre(pb))) > max_angle:
                    continue
                near = np.arccos(np.clip(np.array(cells[t - 1, a]) @ np.array(cells[t, b]).T, -1, 1)) <= angle
                sim = min(near.any(axis=1).mean(), near.any(axis=0).mean())
                if sim >= least:
                    f, g = feat(pa), feat(pb)
                    cand.append((w[0] * sim + w[1] * (f @ g) / (np.linalg.norm(f) * np.linalg.norm(g)) + w[2] * (ahead @ centre(pb)), a, b))
        used_a, used_b = set(), {}
        for _, a, b in sorted(cand, key=lambda x: (-x[0], x[1], x[2])):
            if a not in used_a and b not in used_b:
                used_a.add(a)
                used_b[b] = a
        for b in by_t.get(t, {}):
            if b in used_b:
                now[b] = (active[used_b[b]][0], centre(by_t[t - 1][used_b[b]]))
                merges |= {(t, now[b][0], active[a][0]) for _, a, x in cand if x == b and a not in used_a}
            else:
                now[b] = (f"{t}:{b}", None)
            chains[t, b] = now[b][0]
        active = now
    return chains, merges


def test_tracked_and_stitched_clusters_match_brute_force(spark):
    units = spark.createDataFrame(moving_clumps(), "track_id long, t int, ux double, uy double, uz double, mean_fluo double")
    members, per = (df.cache() for df in clusters.find_clusters(units, 0.08, 4))
    place = members.join(units.select("track_id", "t", "ux", "uy", "uz"), ["track_id", "t"])
    chains, merges = clusters.track_clusters(units, members, per, 0.06)
    want, gone = brute_tracking(per.collect(), place.collect(), 0.06, math.radians(20), 0.4, (1.0, 0.5, 0.5))
    got = {(r.t, r.cluster_id): r.chain_id for r in chains.collect()}
    assert got == want and len(set(got.values())) >= 4
    assert {(r.t, r.merged_into, r.merged_from) for r in merges.collect()} == gone
    # the resting clump is missing for two frames and comes back as the same one
    names, log = clusters.stitch_chains(chains.join(per, ["t", "cluster_id"]), place, 0.06)
    joined = {r.chain_id: r.stitched for r in names.collect()}
    assert joined["7:20"] == "0:20" and sum(a != b for a, b in joined.items()) >= 1
    entry = [r for r in log.collect() if r.child == "7:20"]
    assert len(entry) == 1 and (entry[0].parent, entry[0].gap) == ("0:20", 2) and entry[0].sim == pytest.approx(1) and entry[0].score == pytest.approx(2, abs=1e-3)
    # two datasets are tracked apart, and nothing is tracked in an empty one
    both = lambda df: df.withColumn("well", F.explode(F.array(F.lit("a"), F.lit("b"))))
    twice, _ = clusters.track_clusters(both(units), both(members), both(per), 0.06, dataset="well")
    assert {(r.well, r.t, r.cluster_id): r.chain_id for r in twice.collect()} == {(well, *k): v for k, v in want.items() for well in "ab"}
    assert clusters.track_clusters(units.where("false"), members.where("false"), per.where("false"), 0.06)[0].count() == 0


def test_learned_classes(spark):
    rng = np.random.RandomState(1)
    rows = [(i, *map(float, rng.randn(2) + (6 if i % 2 else 0)), float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    mix = stats.mixture(df, ["a", "b"]).collect()
    assert len({(r.component, r.y) for r in mix}) == 2 and all(sum(r.probability) == pytest.approx(1) for r in mix) and mix[0].log_likelihood < 0
    scored = stats.forest(df, df, ["a", "b"], "y").collect()
    assert all(r.predicted == r.y and sum(map(math.exp, r.log_p)) == pytest.approx(1, abs=1e-6) for r in scored)
    held = stats.held_out_accuracy(df, ["a", "b"], "y", "k").first()
    assert held.accuracy == 1.0 and 20 <= held.n <= 60
    cls = materials.predict_class(df.where("k < 150"), df.where("k >= 150"), ["a", "b"], "y").collect()
    assert len(cls) == 50 and all(r.class_logistic == r.y and r.class_mlp == r.y for r in cls)
    line = df.withColumn("age", 3 * F.col("a") - F.col("b") + 10)
    age = materials.predict_age(line, line, ["a", "b"], "age").collect()
    assert all(r.age_linear == pytest.approx(r.age, abs=0.1) for r in age) and np.mean([abs(r.age_trees - r.age) for r in age]) < 3


def test_bands_variances_and_entropies(spark):
    rows = [(e, t, float(e + t)) for e in range(9) for t in range(20)]
    df = spark.createDataFrame(rows, "e long, t int, v double")
    band = stats.bootstrap_band(df, "v", "e", 5, 60).orderBy("t").collect()
    assert len(band) == 20 and all(r.low <= r.mean <= r.high for r in band) and band[10].mean == pytest.approx(14)
    assert stats.rolling_band(df.groupBy("t").agg(F.avg("v").alias("v")), "v", 5).where("t = 10").first().v_roll == pytest.approx(14)
    pairs = spark.createDataFrame([("g", 1, 1.0), ("g", 1, 4.0), ("g", 2, 2.0), ("g", 2, 2.0), ("g", 3, 9.0), ("h", 1, None)], "g string, p long, v double")
    got = {r.g: (r.var_pair, r.n_pairs, r.n) for r in stats.paired_variances(pairs, ["g"], "v", "p").collect()}
    assert got == {"g": (4.5, 2, 5), "h": (None, 0, 0)}
    v = spark.createDataFrame([("m", "a", 1, 1.0), ("m", "a", 2, math.e), ("m", "b", 1, 1.0)], "m string, k string, d int, var double")
    out = stats.entropy_by_class(v, ["m"], "k", spark.createDataFrame([("m", 2.0), ("m", 4.0)], "m string, error double")).first()
    half = 0.5 * math.log(2 * math.pi * math.e)
    assert (out.entropy_a, out.entropy_b, out.error) == pytest.approx((2 * half + 0.5, half, 3.0))


def test_runs_attributes_and_sorted_files(spark, tmp_path):
    rows = [(i, t, float(t), run, flow) for run, flow, last in (("a", False, 60), ("b", True, 60), ("c", True, 20)) for i in range(2) for t in range(last)]
    k = spark.createDataFrame(rows, "track_id long, t int, x double, run string, with_flow boolean")
    tables.write_table(k, f"{tmp_path}/runs", partition_by=("run", "with_flow"))
    one = tables.read_run(spark, f"{tmp_path}/runs", 5, 40)
    assert {r.run for r in one.collect()} == {"b"} and one.count() == 72
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "PushedFilters: [IsNotNull(t)" in plan
    assert {r.run for r in tables.read_run(spark, f"{tmp_path}/runs", 5, 40, prefer_flow=False).collect()} == {"a"}
    with pytest.raises(ValueError, match="no run covers"):
        tables.read_run(spark, f"{tmp_path}/runs", 5, 400)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{"voxel_size_um": [2.0, 0.5, 0.5],\n "time_resolution_s": 90, "channels": ["H2B", "GFP"], "more": 1}')
    (tmp_path / "d" / "two.json").write_text("no json")
    got = {r.source_file.split("/")[-1]: (r.voxel_size_um, r.time_resolution_min, r.channels) for r in tables.read_attributes(spark, f"{tmp_path}/d/*.json").collect()}
    assert got == {"one.json": ([2.0, 0.5, 0.5], 1.5, ["H2B", "GFP"]), "two.json": (None, None, None)}
    tables.write_sorted(k.select("track_id", "t", "x"), f"{tmp_path}/sorted")
    files = sorted((tmp_path / "sorted").glob("*.parquet"))
    order = [(r.track_id, r.t) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert order == sorted(order) and len(order) == k.count()
    tables.write_coefficients(spark.createDataFrame([(0, [1.0, 2.0])], "t int, coeffs array<double>"), f"{tmp_path}/sh")
    assert spark.read.json(f"{tmp_path}/sh").first().coeffs == [1.0, 2.0]


def test_fields_at_tracks(spark):
    k = spark.createDataFrame([(1, 0, 0.0, 0.1, 0.2), (1, 1, 7.5, 0.1, 0.2), (1, 2, 8.0, 0.1, 0.2), (1, 3, 99.0, 0.1, 0.2), (2, 0, 0.0, 3.0, 1.0)], "track_id long, t int, time_min double, theta double, phi double")
    pix = H.with_pixel(k, 2).where("track_id = 1").first().pix
    field = spark.createDataFrame([(0, pix, 5.0), (1, pix, 6.0), (2, pix, None)], "t_idx int, pix long, density double")
    got = {(r.track_id, r.t): r.density for r in tables.augment_tracks(k, field, 2, 15.0).collect()}
    assert got == {(1, 0): 5.0, (1, 1): 5.0, (1, 2): 6.0, (1, 3): None, (2, 0): None}


def test_flat_frames_have_no_algebraic_sphere(spark):
    rows = [(0, 0.0, 0.0, 0.0), (0, 1.0, 0.0, 0.0), (0, 0.0, 1.0, 0.0)] + [(1, float(a), float(b), 0.0) for a in range(3) for b in range(3)]
    out = surface.algebraic_sphere(spark.createDataFrame(rows, "t int, x double, y double, z double")).collect()
    assert len(out) == 2 and all(r.radius is None and r.center_x is None for r in out)


def test_widths():
    assert G.fwhm_to_sigma(2 * math.sqrt(2 * math.log(2))) == pytest.approx(1) and G.fwhm_to_sigma(0) == G.fwhm_to_sigma(-1) == 1.0


def test_trend_is_not_pulled_by_a_wild_value(spark):
    rows = [("a", t, 10.0 + 0.5 * t + (200.0 if t == 20 else 0.01 * (t % 3))) for t in range(40)]
    df = spark.createDataFrame(rows, "g string, t int, v double")
    robust = {r.t: r.trend for r in materials.lowess_threshold(df, "g", "t", "v").collect()}
    plain = {r.t: r.trend for r in materials.lowess_threshold(df, "g", "t", "v", robust=0).collect()}
    assert all(abs(robust[t] - (10 + 0.5 * t)) < 0.1 for t in range(40)) and abs(plain[20] - 20) > 5


def test_resampling_and_surface_velocity(spark):
    from orbitrace.operators import tracks as T

    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 3.0, 0.0), (2, 5.0, 7.0), (3, 0.0, None), (3, 1.0, 4.0)], "track_id long, t double, v double")
    got = {(r.track_id, round(r.t, 6)): r.v for r in T.resample(df, ["v"], 0.5).collect()}
    assert got == {
        (1, 0.0): 0.0, (1, 0.5): 5.0, (1, 1.0): 10.0, (1, 1.5): 7.5, (1, 2.0): 5.0, (1, 2.5): 2.5, (1, 3.0): 0.0, (2, 5.0): 7.0, (3, 0.0): None, (3, 0.5): None, (3, 1.0): 4.0,
    }
    assert T.resample(df.where("false"), ["v"], 0.5).count() == 0
    k = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0), (1, 1, 2.0, 1.0, 0.0), (2, 0, 0.0, 0.0, 0.0)], "track_id long, t int, x double, y double, z double").withColumns({c: F.lit(0.0) for c in ("a", "b", "c")})
    out = {(r.track_id, r.t): (r.vx, r.vy, r.speed) for r in T.unit_step_velocity(k, ("a", "b", "c")).collect()}
    # the step (1, 1, 0) less its part along (1, 0, 0), and less its part along (2, 1, 0)
    assert out[1, 0] == pytest.approx((0.0, 1.0, 1.0)) and out[1, 1] == pytest.approx((-0.2, 0.4, math.sqrt(0.2))) and out[2, 0] == (None, None, None)


def test_grouped_quantiles_match_numpy_and_keep_null_groups(spark, monkeypatch):
    monkeypatch.setattr(stats, "RANK_BLOCK", 7)
    rng = np.random.RandomState(5)
    # a third of the rows in one group, ties, nulls, a group of nulls only
    rows = [(int(g), float(v) if rng.rand() > 0.1 else None) for g, v in zip(np.where(rng.rand(900) < 0.33, 0, rng.randint(0, 12, 900)), rng.randint(0, 60, 900), strict=True)]
    rows += [(None, 1.0), (None, 4.0), (99, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    held = {}
    for g, v in rows:
        if v is not None:
            held.setdefault(g, []).append(v)
    got = {r.g: (r.a, r.b, r.c) for r in stats.grouped_quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == set(held) and all(got[g] == pytest.approx(np.quantile(v, [0.1, 0.5, 1.0])) for g, v in held.items())
    out = {r.g: r for r in stats.percentiles_by(df, "g", "v").collect()}
    assert out[99].n == 1 and out[99].p_low is None and out[None].p_low == pytest.approx(1.3)
    assert stats.exact_quantiles(df.where("false"), "v", [0.5]) == []


def test_panes_hold_the_rows_of_the_windows(spark):
    from orbitrace.operators import fields as FI
    from orbitrace.operators.neighbors import to_windows

    times = [(i, float(t)) for i, t in enumerate(np.random.RandomState(1).choice(np.arange(0, 200, 0.5), 150))]
    df = spark.createDataFrame(times, "i int, m double")
    for window, stride in ((45.0, 1.5), (20.0, 6.0), (3.0, 7.0)):
        centers = FI.window_centers(df, "m", stride)
        want = sorted((r.i, r.t_idx) for r in to_windows(df, "m", window, max(1.0, stride), *centers).collect())
        panes = FI.with_panes(df, "m", window, stride, centers)
        assert sorted((r.i, t) for r in panes.collect() for t in range(r.w_lo, r.w_hi + 1)) == want
        n = {r.t_idx: r.n for r in FI.by_window(panes, [], {"n": F.lit(1).cast("long")}).collect()}
        assert n == {t: sum(x == t for _, x in want) for t in {t for _, t in want}}
