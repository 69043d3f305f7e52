"""Registered queries over all rows of their tables, against brute force."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from orbitrace.plans.all_queries import QUERIES
from orbitrace.sources.testviews import table, tracks, voxels

SF = "/root/testdata/sf0.001"


def test_sequential_pairs_of_all_customers(spark):
    snips = [(r.o_orderkey, r.o_custkey, r.o_orderpriority, r.o_orderdate.toordinal()) for r in table(spark, SF, "orders").collect()]
    pairs = [(a, b, e == f, abs(s - t)) for a, e, c, s in snips for b, f, d, t in snips if c == d and a != b and abs(s - t) <= 3]
    n = Counter((a, own) for a, _, own, _ in pairs)
    want = Counter((a, b, own, round(0.5 / n[a, own], 6), round(apart / 3, 6)) for a, b, own, apart in pairs)
    got = Counter((r.o_orderkey, r.n_key, r.is_self, r.weight, r.penalty) for r in QUERIES["c23_sequential_pairs"](spark, SF).collect())
    assert got == want


def test_components_of_all_users(spark):
    ids = {r.user_id for r in table(spark, SF, "events").select("user_id").distinct().collect()}
    want = {}
    for u in sorted(ids | {u + 7 for u in ids}):
        want[u] = want[u - 7] if u - 7 in ids else u
    got = [tuple(r) for r in QUERIES["i01_graph_components"](spark, SF).select("node", "component").collect()]
    assert len(got) == len(want) and dict(got) == want and max(Counter(want.values()).values()) > 2


def test_smoothing_of_all_rows(spark):
    k = defaultdict(list)
    for r in tracks(spark, SF).orderBy("track_id", "t").collect():
        k[r.track_id].append((r.t, r.x))
    want = {}
    for track, rows in k.items():
        n, x = len(rows), np.array([v for _, v in rows])
        w = min(5, n) - (min(5, n) % 2 == 0)
        for i, (t, v) in enumerate(rows):
            a = max(0, min(i - w // 2, n - w))
            want[track, t] = v if w < 3 else np.polyval(np.polyfit(np.arange(w) - (i - a), x[a : a + w], 2), 0)
    got = {(r.track_id, r.t): r.x_s for r in QUERIES["e05_savgol"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[at] == pytest.approx(v, abs=2e-6) for at, v in want.items())


def test_hexagon_counts_are_smoothed(spark):
    count, frames = Counter(), set()
    for r in tracks(spark, SF).collect():
        hy = round(r.y / (100 * 0.8660254037844386))
        count[r.t, round(r.x / 100 - hy % 2 * 0.5), hy] += 1
        frames.add(r.t)
    density = Counter()
    for (t, hx, hy), n in count.items():
        for c in frames:
            if abs(c - t) <= 25:
                density[c, hx, hy] += n / sum(abs(c - f) <= 25 for f in frames)
    want = {}
    for (t, hx, hy), d in density.items():
        o = hy % 2
        near = ((hx, hy), (hx - 1, hy), (hx + 1, hy), (hx - 1 + o, hy - 1), (hx + o, hy - 1), (hx - 1 + o, hy + 1), (hx + o, hy + 1))
        want[t, hx, hy] = (d, sum(density.get((t, *b), 0) for b in near) / 7)
    got = {(r.t, r.hx, r.hy): (r.density, r.smooth) for r in QUERIES["e25_hex_counts"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[at] == pytest.approx(v, abs=2e-6) for at, v in want.items())


def gapped_rows(spark):
    """(track, t, place) of all rows with five frames missing after every twenty, a track of its own between two gaps."""
    return [(r.track_id * 100 + r.t // 20, r.t + 5 * (r.t // 20), (r.x, r.y, r.z)) for r in tracks(spark, SF).collect()]


def test_gaps_of_all_tracks_are_closed(spark):
    ends, starts = {}, {}
    for k, t, p in sorted(gapped_rows(spark)):
        starts.setdefault(k, (t, p))
        ends[k] = (t, p)
    pairs = sorted((math.dist(p, q), a, b, s - t) for a, (t, p) in ends.items() for b, (s, q) in starts.items() if a != b and 1 <= s - t <= 7 and math.dist(p, q) <= 60)
    want, used, taken = {}, set(), set()
    for d, a, b, gap in pairs:
        if a not in used and b not in taken:
            used.add(a)
            taken.add(b)
            want[a, b] = (gap, round(d, 6))
    got = {(r.parent, r.child): (r.gap, r.distance) for r in QUERIES["i06_close_gaps"](spark, SF).collect()}
    assert got.keys() == want.keys() and len(got) > 10
    assert all(got[k] == (want[k][0], pytest.approx(want[k][1], abs=2e-6)) for k in want)


def test_stitched_tracks_are_chains_over_gaps(spark):
    """Every joined segment follows another one of its track within the gap and the distance, and the name is the first one's."""
    rows = defaultdict(list)
    for k, t, p in sorted(gapped_rows(spark)):
        rows[k].append((t, p))
    joined = defaultdict(list)
    for r in QUERIES["i03_stitch"](spark, SF).collect():
        joined[r.stitched].append(r.seg)
    assert sorted(s for segs in joined.values() for s in segs) == sorted(rows) and any(len(s) > 2 for s in joined.values())
    for name, segs in joined.items():
        segs.sort(key=lambda s: rows[s][0][0])
        assert segs[0] == name
        for a, b in zip(segs[:-1], segs[1:], strict=True):
            (t, p), (s, q) = rows[a][-1], rows[b][0]
            assert 1 <= s - t <= 7 and math.dist(p, q) <= 60


def test_all_points_are_linked_as_a_stream(spark):
    frames = defaultdict(list)
    for r in tracks(spark, SF).collect():
        frames[r.track_class, r.t].append((r.track_id, (r.x, r.y, r.z)))
    names = {}
    for c, t in sorted(frames):
        before = frames.get((c, t - 1), [])
        pairs = sorted((math.dist(p, q), a, b) for a, p in before for b, q in frames[c, t] if math.dist(p, q) <= 15)
        used, taken = set(), {}
        for _, a, b in pairs:
            if a not in used and b not in taken:
                used.add(a)
                taken[b] = a
        for b, _ in frames[c, t]:
            names[c, t, b] = names[c, t - 1, taken[b]] if b in taken else f"{t}:{b}"
    got = {(r.dataset, r.t, r.id): r.track_id for r in QUERIES["k03_stream_links"](spark, SF).collect()}
    assert got == names


def test_chain_statistics_of_all_clusters(spark):
    out = QUERIES["d35_chain_stats"](spark, SF).collect()
    chain = {(r.t, r.cluster_id): r.chain_id for r in QUERIES["i02_link_clusters"](spark, SF).collect()}
    size = {(r.t, r.cluster_id): r.size for r in QUERIES["d34_clusters"](spark, SF).collect()}
    assert {(r.t, r.cluster_id) for r in out} == set(chain)
    own = defaultdict(list)
    for at, c in chain.items():
        own[c].append(at)
    for r in out:
        at = own[chain[r.t, r.cluster_id]]
        times, sizes = [t for t, _ in at], [size[x] for x in at]
        assert (r.chain_id, r.start_t, r.end_t, r.duration, r.max_size, r.n_obs) == (chain[r.t, r.cluster_id], min(times), max(times), max(times) - min(times) + 1, max(sizes), len(at))
        assert r.mean_size == pytest.approx(sum(sizes) / len(sizes), abs=2e-6)


def test_labels_are_assigned_greedily(spark):
    held = defaultdict(set)
    for r in voxels(spark, SF).collect():
        held[r.t, r.z, r.y, r.x].add((r.channel == 1, r.label))
    n = Counter((a, b) for labels in held.values() for one, a in labels if one for two, b in labels if not two)
    want, used, taken = {}, set(), set()
    for (a, b), k in sorted(n.items(), key=lambda x: (-x[1], x[0])):
        if a not in used and b not in taken:
            used.add(a)
            taken.add(b)
            want[a, b] = k
    assert {(r.label, r.other_label): r.n for r in QUERIES["f05_greedy_assignment"](spark, SF).collect()} == want
