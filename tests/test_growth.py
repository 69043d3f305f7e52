"""Plans and results of operators that must not copy or pair rows as tables grow."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitrace.operators import msd as M


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_tracks_are_not_copied(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t * 2, *map(float, rng.normal(size=3))) for k, n in ((1, 9), (2, 6), (3, 5)) for t in range(n)]
    df = spark.createDataFrame(rows, "track_id long, t int, x double, y double, z double")
    out = M.sliding_msd(df, 6, 2, 9)
    assert "Join" not in plan(out)
    want, place = {}, defaultdict(list)
    for k, _, *p in rows:
        place[k].append(p)
    for k, p in place.items():
        for s in range(0, len(p) - 5, 2):
            for tau in range(1, 6):
                d = [math.dist(p[i], p[i + tau]) ** 2 for i in range(s, s + 6 - tau)]
                want[k, s, tau] = (pytest.approx(sum(d) / len(d)), len(d))
    assert {(r.track_id, r.start_idx, r.tau): (r.msd, r.n_obs) for r in out.collect()} == want
    assert M.sliding_msd(df, 1, 2, 9).count() == 0


def test_shadows_of_many_tiles(spark, monkeypatch):
    from orbitrace.operators import regions as V

    monkeypatch.setattr(V, "TILE", 20)
    monkeypatch.setattr(V, "PAIRS", 500)
    rng = np.random.default_rng(4)
    rows = [(int(t), float(rng.integers(0, 60)), int(y), int(x), int(k)) for t, k, y, x in zip(rng.integers(0, 2, 4000), rng.integers(0, 120, 4000), rng.integers(0, 12, 4000), rng.integers(0, 12, 4000), strict=True)]
    df = spark.createDataFrame(rows, "t int, z double, y int, x int, label int")
    flat, depth = defaultdict(set), defaultdict(list)
    for t, z, y, x, k in rows:
        if k > 0:
            flat[t, k].add((y, x))
            depth[t, k].append(z)
    mean = {k: sum(v) / len(v) for k, v in depth.items()}
    want = {a for a in flat for b in flat if a[0] == b[0] and a != b and len(flat[a] & flat[b]) / len(flat[a]) >= 0.3 and -10 <= mean[b] - mean[a] < 0}
    got = [(r.t, r.label) for r in V.shadowed_labels(df, 0.3, 1.0, -10.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 10 < len(want) < len(flat) - 10


def test_overlap_of_clusters_writes_no_member_pairs(spark, monkeypatch):
    from orbitrace.operators import clusters as K

    monkeypatch.setattr(K, "radius_pairs", None)  # member pairs as rows
    rng = np.random.default_rng(5)
    p = rng.normal(size=(300, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    rows = [(i % 3, i % 7, i, *map(float, u)) for i, u in enumerate(p)]
    members = spark.createDataFrame(rows, "t int, cluster_id int, track_id int, ux double, uy double, uz double")
    asked = [(s, a, t, b) for s, t in ((0, 1), (0, 2)) for a in range(7) for b in range(0, 7, 2)]
    got = {(r.ta, r.a, r.tb, r.b): r.sim for r in K.geometric_overlap(spark.createDataFrame(asked, "ta int, a int, tb int, b int"), members, 0.3).collect()}
    want = {}
    for s, a, t, b in asked:
        one, two = (p[[r[2] for r in rows if r[0] == f and r[1] == c]] for f, c in ((s, a), (t, b)))
        near = np.linalg.norm(one[:, None] - two[None], axis=2) <= 2 * math.sin(0.15)
        if near.any():
            want[s, a, t, b] = pytest.approx(min(near.any(1).mean(), near.any(0).mean()))
    assert got == want and len(want) > 20


def test_labels_of_a_voxel_are_summed_before_they_meet(spark, monkeypatch):
    from orbitrace.operators import regions as V

    monkeypatch.setattr(V, "label_overlap", None, raising=False)  # a row for each pair of labels
    rng = np.random.default_rng(6)
    cells = lambda n, k: [(int(t), int(z), 0, int(x), int(i)) for t, z, x, i in zip(rng.integers(0, 2, n), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, k, n), strict=True)]
    one, two = cells(150, 9), cells(90, 7)
    value = {k: None if k == 3 else float(k * k) for k in range(6)}  # label 6 has no row, 3 no value
    schema = "t int, z int, y int, x int, label int"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame([*two, (None, 0, 0, 0, 1)], schema)
    v = spark.createDataFrame(list(value.items()), "label int, mean_fluo double")
    meet = [(p[4], q[4]) for p in set(one) for q in set(two) if p[:4] == q[:4]]
    want = {}
    for k in {p for p, q in meet if q in value}:
        near = [value[q] for p, q in meet if p == k and q in value]
        want[k] = pytest.approx(sum(x for x in near if x is not None) / len(near))
    assert {r.label: r.fluo for r in V.transfer_fluorescence(a, b, v).collect()} == want and len(want) == 9
    size, shade = ({k: sum(p[4] == k for p in rows) for k in range(9)} for rows in (set(one), [(0, 0, 0, 0, p) for p, _ in meet]))
    most = sorted(shade[k] / size[k] for k in size)[4]
    bright = [r.label for r in V.brightest_uncovered(b, a, spark.createDataFrame([(k, float(k)) for k in range(9)], "label int, mean_fluo double"), 4, most).collect()]
    assert bright == sorted((k for k in size if shade[k] / size[k] <= most), reverse=True)[:4]


def test_tasks_of_an_overlap_follow_the_pairs(spark, monkeypatch):
    from orbitrace import session
    from orbitrace.operators.neighbors import label_overlap

    monkeypatch.setattr(session, "TASK_ROWS", 100)
    rows = [(0, 0, 0, x, k) for x in range(3) for k in range(30)] + [(0, 0, 0, None, 1)]
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, label int")
    out = label_overlap(df, df)
    assert out.rdd.getNumPartitions() == 27  # 3 voxels of 30 by 30 labels
    assert {(r.label, r.other_label): r.n for r in out.collect()} == {(i, j): 3 for i in range(30) for j in range(30)}
    assert label_overlap(df.where("label > 99"), df).count() == 0


def test_nearest_pairs_over_gaps_are_taken_without_writing_all(spark, monkeypatch):
    from orbitrace.operators import clusters as K

    rng = np.random.default_rng(7)
    segs = [(k, int(s), int(s + n), *map(float, rng.integers(0, 9, 6))) for k, (s, n) in enumerate(zip(rng.integers(0, 12, 120), rng.integers(0, 4, 120), strict=True))]
    pairs = [(math.dist(a[6:], b[3:6]), a[0], b[0], b[1]) for a in segs for b in segs if a[0] != b[0] and 1 <= b[1] - a[2] <= 3]
    want, lefts, rights = set(), set(), set()
    for d, a, b, t in sorted(p for p in pairs if p[0] <= 4):
        if a not in lefts and b not in rights:
            want.add((t, a, b, round(d, 9)))
            lefts.add(a)
            rights.add(b)
    df = spark.createDataFrame(segs, "seg long, t_start int, t_end int, sx double, sy double, sz double, ex double, ey double, ez double")
    given = []
    greedy = K.greedy_assignment
    monkeypatch.setattr(K, "greedy_assignment", lambda scores, *a: given.append(scores.count()) or greedy(scores, *a))
    for bound in (K.LOCAL_PAIRS, 1000):  # rounds down to 10 open rows
        monkeypatch.setattr(K, "LOCAL_PAIRS", bound)
        got = {(r.t_start, r.seg, r.n_seg, round(r.distance, 9)) for r in K.gap_links(df, 2, 4.0).collect()}
        assert got == want and len(want) > 20
    assert given[0] == sum(p[0] <= 4 for p in pairs) and given[1] < given[0] / 4


def test_steps_are_sent_to_few_blocks(spark, monkeypatch):
    from orbitrace.operators import fields as D

    rng = np.random.default_rng(8)
    v = rng.normal(size=(60, 3))
    u = (math.sin(0.3) * math.cos(0.2), math.sin(0.3) * math.sin(0.2), math.cos(0.3))
    rows = [(1, k, 0.0, 0.3, 0.2, *u, *map(float, p)) for k, p in enumerate(v)]
    df = spark.createDataFrame(rows, "track_id long, t int, mid_time double, theta double, phi double, ux double, uy double, uz double, vx double, vy double, vz double")
    written = {}
    write = D.materialize
    monkeypatch.setattr(D, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(D, "PAIR_ROWS", 8)
    got = D.misalignment_entropy(df, 1, 0.6, 10.0, 10.0)
    h = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = np.triu_indices(60, 1)
    p = np.bincount(np.minimum((np.arccos((h @ h.T)[i, j]) * 36 / math.pi).astype(int), 35)) / len(i)
    want = -np.sum(p[p > 0] * np.log(p[p > 0])) / math.log(36)
    out = got.where("t_idx = 0").collect()
    assert len(out) >= 1 and all(r.entropy == pytest.approx(want) for r in out)
    assert written["blocks"].count() == len(out)  # one block a pixel, so no step is copied


def test_mixture_works_its_rows_out_once(spark):
    from orbitrace.operators import stats as S

    df = spark.createDataFrame([(i % 20, float(i % 7 + 50 * (i % 2)), float(i % 5)) for i in range(400)], "k int, a double, b double")
    df = df.groupBy("k").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))
    out = S.mixture(df, ["a", "b"])
    assert "Aggregate" not in plan(out)
    rows = out.collect()
    assert {r.k for r in rows} == set(range(20)) and all(sum(r.probability) == pytest.approx(1) for r in rows)


def test_duplicates_are_sought_in_blocks(spark, monkeypatch):
    from orbitrace.operators import lineage as L

    monkeypatch.setattr(L, "radius_pairs", None, raising=False)  # rows copied to the cells around them
    rows = [(k, t, 10.0 * (k % 4) + 0.1 * t + (1.0 if k > 3 else 0.0), -5.0 * k % 20, 0.0) for k in range(8) for t in range(6)] + [(None, 0, 0.0, 0.0, 0.0), (9, 0, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "track_id long, t int, x double, y double, z double")
    got = {(r.track_id, r.t): r.n_fused for r in L.fuse_duplicates(df, 2.0).collect()}
    assert got == {(k, t): 2 for k in range(4) for t in range(6)} | {(None, 0): 1, (9, 0): 1}


def test_sequential_pairs_are_counted_before_they_are_made(spark):
    from collections import Counter

    from orbitrace.operators import stats as S

    rng = np.random.default_rng(9)
    rows = [(k, None if k % 9 == 0 else k % 4, "ab"[k % 2], int(a)) for k, a in enumerate(rng.integers(0, 15, 60))] + [(None, 1, "a", 3), (70, 1, None, 3), (71, 1, "a", None), (5, 2, "b", 4)]
    df = spark.createDataFrame(rows, "k long, e int, c string, age int")
    out = S.sequential_pairs(df, "e", "c", "age", 3.0, "k", 0.25)
    assert "Window" not in plan(out)  # no pair is shuffled
    pairs = [(a, b, None if e is None or f is None else e == f, abs(s - t) / 3) for a, e, c, s in rows for b, f, d, t in rows if None not in (a, b, c, d, s, t) and c == d and a != b and abs(s - t) <= 3]
    n = Counter((a, own) for a, _, own, _ in pairs)
    want = Counter((a, b, own, round((0.25 if own else 0.75) / n[a, own], 9), round(apart, 9)) for a, b, own, apart in pairs)
    assert Counter((r.k, r.n_key, r.is_self, round(r.weight, 9), round(r.penalty, 9)) for r in out.collect()) == want
    assert S.sequential_pairs(df.where("k > 99"), "e", "c", "age", 3.0, "k").count() == 0


def test_radius_pairs_of_all_cells_meet_in_blocks(spark, monkeypatch):
    from orbitrace.operators import neighbors as N
    from orbitrace.plans.all_queries import QUERIES
    from orbitrace.sources.testviews import tracks

    sf = "/root/testdata/sf0.01"
    monkeypatch.setattr(N, "radius_pairs", None)  # rows copied to the cells around them
    frames = defaultdict(list)
    for r in tracks(spark, sf).collect():
        frames[r.t].append((r.track_id, (r.x, r.y, r.z)))
    want = {(a, t, b): pytest.approx(math.dist(p, q), abs=6e-7) for t, rows in frames.items() for a, p in rows for b, q in rows if math.dist(p, q) <= 75}
    got = QUERIES["c06_radius_pairs"](spark, sf).collect()
    assert len(got) == len(want) and {(r.track_id, r.t, r.n_track_id): r.distance for r in got} == want
    assert all(round(r.distance, 6) == r.distance for r in got) and any(r.track_id != r.n_track_id for r in got)


def test_listed_and_set_out_nearest_rows_are_the_same(spark, monkeypatch):
    from orbitrace.operators import blocks as B

    rng = np.random.default_rng(10)
    a, b = rng.integers(0, 12, (150, 3)) / 2, rng.integers(0, 12, (200, 3)) / 2  # many ties
    want = np.linalg.norm(a[:, None] - b[None], axis=2)
    monkeypatch.setattr(B, "PIECE", 100)
    pairs = [(rows[p], q, d) for rows, i, j, d in B.listed(a, b, 1.5) for p, q, d in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)]
    assert len(pairs) == (want <= 1.5).sum() > 500 and all(want[i, j] == pytest.approx(d) for i, j, d in pairs)
    one, two = (spark.createDataFrame([(k, k % 2, *map(float, p)) for k, p in enumerate(x)], "track_id long, t int, x double, y double, z double") for x in (a, b))
    got = []
    for most in (B.LISTED, 0):
        monkeypatch.setattr(B, "LISTED", most)
        got += [sorted(map(tuple, B.near_first(left, two, 3, 1.5, include_self=own).collect())) for left, own in ((one, True), (one, False), (two, False))]
    assert got[:3] == got[3:] and len(got[0]) > 200


def test_cages_of_material_fields_are_not_joined(spark):
    from orbitrace.operators import materials

    rng = np.random.default_rng(11)
    rows = []
    for k in range(30):
        p, q = rng.normal(size=3), rng.normal(size=3)
        u = p / np.linalg.norm(p)
        rows.append((k, k % 5, float(3 if k % 2 else 12), 0.5, *map(float, (math.acos(u[2]), math.atan2(u[1], u[0]), *u, *p, *(p + 0.1 * q)))))
    df = spark.createDataFrame(rows, "track_id long, t int, dt double, mid_time double, theta double, phi double, ux double, uy double, uz double, x0 double, y0 double, z0 double, x double, y double, z double")
    out = materials.material_fields(df, 1, 2.0, 5, 10.0, 10.0)
    assert "Join" not in plan(out) and out.count() == 12 * len({r.t_idx for r in out.collect()}) > 0


def test_rows_of_a_streamed_frame_are_sent_as_one(monkeypatch):
    import pyarrow as pa

    from orbitrace.streaming import linking

    assert "array<double>" not in linking.STATE  # numbers one at a time
    rng = np.random.default_rng(12)
    k, t = rng.integers(0, 2, 100), rng.integers(0, 3, 100)
    cols = {"well": pa.array([f"w{i}" for i in k]), "ts": pa.array(t * 90_000_000, pa.timestamp("us", tz="UTC")), "t": pa.array(t, pa.int32()), "id": pa.array(np.arange(100))}
    batches = pa.table(cols | {a: pa.array(np.arange(100) + 0.5) for a in "xyz"}).to_batches(max_chunksize=7)
    for most, parts in ((linking.PACKED, 1), (50, 2)):
        monkeypatch.setattr(linking, "PACKED", most)
        out = list(linking._packed("well", "ts")(iter(batches)))
        got = [(r["well"], int(x["w_ts"]), int(x["w_t"]), int(x["w_id"]), float(x["w_z"])) for b in out for r in b.to_pylist() for x in np.frombuffer(r["rows"], linking.WAITING)]
        assert sorted(got) == sorted((f"w{a}", 90_000 * int(b), int(b), i, i + 0.5) for i, (a, b) in enumerate(zip(k, t, strict=True)))
        assert len(out) == parts and sum(b.num_rows for b in out) == 6 * parts


def test_links_of_frames_are_taken_without_writing_all_pairs(spark, monkeypatch):
    from orbitrace.operators import clusters as K

    rng = np.random.default_rng(13)
    one, two = ([(k, k % 2, *map(float, p)) for k, p in enumerate(rng.integers(0, 60, (n, 3)) / np.array([1, 1, 20]))] for n in (400, 380))
    schema = "id long, t int, x double, y double, z double"
    a, b = spark.createDataFrame([*one, (500, 0, None, 0.0, 0.0), (501, None, 1.0, 1.0, 1.0)], schema), spark.createDataFrame(two, schema)

    def greedy_of(left, right, radius):
        want, lefts, rights = set(), set(), set()
        for d, p, q, t in sorted((math.dist(p[2:], q[2:]), p[0], q[0], p[1]) for p in left for q in right if p[1] == q[1] and math.dist(p[2:], q[2:]) <= radius):
            if (t, p) not in lefts and (t, q) not in rights:
                want.add((t, p, q, round(d, 9)))
                lefts.add((t, p))
                rights.add((t, q))
        return want

    given, greedy = [], K.greedy_assignment
    monkeypatch.setattr(K, "greedy_assignment", lambda scores, *x: given.append(scores.count()) or greedy(scores, *x))
    for bound in (K.LOCAL_PAIRS, 3000):  # rounds down to 30 open rows
        monkeypatch.setattr(K, "LOCAL_PAIRS", bound)
        got = [(r.t, r.id, r.n_id, round(r.distance, 9)) for r in K.frame_assignment(a, b, 4.0, "t", "id", 2).collect()]
        assert len(got) == len(set(got)) > 150 and set(got) == greedy_of(one, two, 4.0)
    assert given[1] < given[0] / 4
    again = [*one, (3, 1, 30.0, 30.0, 1.0)]  # a key twice in a frame
    got = {(r.t, r.id, r.n_id, round(r.distance, 9)) for r in K.frame_assignment(spark.createDataFrame(again, schema), b, 4.0, "t", "id").collect()}
    assert got == greedy_of(again, two, 4.0) and given[2] >= given[0]


def test_large_frames_are_assigned_without_rounds(spark, monkeypatch):
    from orbitrace.operators import assignment as A

    monkeypatch.setattr(A, "LOCAL_PAIRS", 100)
    rng = np.random.default_rng(14)
    pairs = {(t, int(i), int(j)): float(s) for t, n in ((0, 300), (1, 60), (2, 200)) for i, j, s in zip(rng.integers(0, 30, n), rng.integers(0, 30, n), rng.random(n), strict=True)}
    df = spark.createDataFrame([(t, f"{t}:{i}", f"{t}:{j}", s) for (t, i, j), s in pairs.items()], "t int, a string, b string, s double")
    monkeypatch.setattr(A, "_by_rounds", None)  # an auction
    seen, find = [], A.connected_components
    monkeypatch.setattr(A, "connected_components", lambda edges, **k: seen.append(edges.count()) or find(edges, **k))
    for rows, parts in ((df, sum(t == 1 for t, _, _ in pairs)), (df.where("t <> 1"), 0)):
        seen.clear()
        got = A.optimal_assignment(rows, "a", "b", "s", group="t").collect()
        assert sum(seen) == parts and len({r.a for r in got}) == len(got) == len({r.b for r in got})
        want = sum(r.s for r in A.optimal_assignment(rows, "a", "b", "s").collect())
        assert sum(r.s for r in got) == pytest.approx(want)
