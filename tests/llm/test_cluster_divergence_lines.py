from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orbitrace.llm import line_dedup
from orbitrace.llm.centroid_clusters import DIM, cluster_vectors, hadamard, nearest_centroids
from orbitrace.llm.line_dedup import Shard, build_index, drop_repeated_lines, line_counts
from orbitrace.llm.source_divergence import audit_sources

VECTORS = "vec_id long, embedding array<float>, cluster string, v string"


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: digest(r[0])) + [r for r in kept if r[0] is None]
    centroids = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[place(v)[1]].append(v)
        for j, vs in own.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = [(i, *reversed(place(v))) for i, v in kept]
    per = Counter()
    for _, j, d in out:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in out), key=repr)


def vector_rows(n=150, seed=1, scale=1.0):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, scale) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3 * scale) for c in rng.choice(centers)]) for i in range(n)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in rows]


def test_hadamard_is_exact_and_coarse_first():
    x = np.random.RandomState(0).randint(-1000, 1000, (7, DIM))
    h = hadamard(x)
    assert (hadamard(h) == DIM * x).all()
    assert ((h**2).sum(axis=1) == DIM * (x**2).sum(axis=1)).all()
    means = np.repeat([3, -1, 4, 9], 16)
    assert (hadamard(means)[4:] == 0).all()


def test_search_finds_the_nearest_with_ties():
    rng = np.random.RandomState(1)
    x, c = rng.randint(-3, 4, (2000, DIM)), rng.randint(-3, 4, (9, DIM))
    c[5], x[:9] = c[2], c  # a repeated centroid, and vectors on centroids
    best, total = nearest_centroids(hadamard(x), hadamard(c))
    whole = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == whole.argmin(axis=1)).all() and (total == DIM * whole.min(axis=1)).all()


@pytest.mark.parametrize("scale", [1.0, 40_000.0])
def test_clusters_match_brute_force(spark, scale):
    rows = vector_rows(scale=scale)
    hard = [(200, None), (201, [0.0] * 63), (202, [float("nan")] * 64), (203, [float("inf")] + [0.0] * 63), (204, [None] + [0.0] * 63), (None, rows[0][1]), (1, rows[1][1]), (205, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows + hard], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(df).collect()), key=repr)
    assert got == brute_clusters(rows + hard)


def test_clusters_of_few_and_of_none(spark):
    assert cluster_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    rows = vector_rows(3)
    got = cluster_vectors(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows)
    with pytest.raises(Exception, match="64-bit"):
        cluster_vectors(spark.createDataFrame([(1, [3e38] * 64, "x", "y")], VECTORS)).collect()


def brute_audit(rows, least, top):
    docs = [((lang or ""), (source or ""), [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for text, lang, source in rows]
    in_docs, n, ln = Counter(), Counter(), Counter()
    for lang, source, words in docs:
        in_docs.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
        ln.update((lang, w) for w in words)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [w for (la, w), c in in_docs.items() if la == lang and c >= least]
        sources = {d[1] for d in docs if d[0] == lang}
        prob = lambda count, total, v=len(kept): 1 + 10**9 * (count + 5) // (total + 5 * v)
        whole = sum(ln[lang, w] for w in kept)
        totals = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        p = {s: {w: prob(n[lang, s, w], totals[s]) for w in kept} for s in sources}
        q = {w: prob(ln[lang, w], whole) for w in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in sources if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.mark.parametrize("tile_groups", [2, 16])
def test_audit_matches_brute_force(spark, tile_groups):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        source, lang = f"s{rng.randint(0, 8)}", rng.choice(["en", "de", None])
        words = [f"{rng.choice(['Wort', 'term', 'ÉTÉ', '漢字'])}{'xyzabcdefg'[rng.randint(0, 9)] * rng.randint(0, 9)}" for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice([" ", "\n", "1", "'"]).join([*words, f"only{source}"] if i % 2 else words), lang, source))
    rows += [(None, "fr", None), ("", "fr", "x"), ("one two", "es", "a"), ("_ 12", "en", "blank"), ("long " * 50_000, "en", "s1"), rows[1], rows[1]]
    df = spark.createDataFrame([(t, la, s, "c") for t, la, s in rows], "text string, lang string, source string, term string").repartition(3)
    got = sorted(tuple(r) for r in audit_sources(df, least_docs=6, top=5, tile_groups=tile_groups).collect())
    assert got == brute_audit(rows, 6, 5)


def test_audit_of_an_empty_table(spark, no_docs):
    assert audit_sources(no_docs).collect() == []


def brute_lines(rows, least_docs=5, least_chars=40):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(list)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            held[k].append(i)
    go = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(k) >= least_chars and len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in go or go[key(x)] is None or go[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(9)
    pool = [f"{k:03d} " + "a line that stands in several texts, letter after letter"[: rng.randint(34, 56)] for k in range(300)] + ["ü" * 39, "ü" * 40, "Ü" * 40, "x" * 40, "x" * 39]
    rows = []
    for i in range(160):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 25))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "\r"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    hot = "one passage that every third document of the table repeats"
    rows = [(i, f"{hot}\n{t}" if i % 3 == 0 else t) for i, t in rows]
    return rows + [(None, "\n".join(pool[:200])), (None, None), (500, None), (501, ""), (502, "\n"), (503, "y" * 300_000 + "\n" + pool[0]), rows[7], rows[7], (7, "another text of the same id\n" + pool[1])]


@pytest.mark.parametrize("bound", [line_dedup.BROADCAST_BYTES, -1])
def test_lines_match_brute_force_by_both_ways(spark, bound, monkeypatch):
    monkeypatch.setattr(line_dedup, "ROUTED_ROWS", 40)
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_lines int").repartition(5)
    got = drop_repeated_lines(df, broadcast_bytes=bound, shard_keys=50, texts=True).collect()
    assert sorted((tuple(r)[:4] for r in got), key=repr) == brute_lines(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_dropped for r in got) > 300


def test_lines_of_an_empty_table(spark, no_docs):
    for bound in (line_dedup.BROADCAST_BYTES, -1):
        assert drop_repeated_lines(no_docs, broadcast_bytes=bound).collect() == []
    with pytest.raises(ValueError):
        drop_repeated_lines(no_docs, least_docs=1)


def test_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.RandomState(4)
    h, f = rng.randint(0, 1 << 62, 20_000).astype(np.uint64), rng.randint(0, 1 << 62, 20_000).astype(np.uint64)
    h[:50] = h[0]  # keys that differ in the second half only
    held = Shard.build(h, f, np.arange(20_000, dtype=np.uint32), np.arange(20_000))
    at = held.probe(h, f)
    assert sorted(at.tolist()) == list(range(20_000))
    assert (held.count[at] == np.arange(20_000)).all()
    other = rng.randint(0, 1 << 62, (2, 20_000)).astype(np.uint64)
    assert (held.probe(*other) == -1).all() and (held.probe(h, f + np.uint64(1)) == -1).all()
    assert len(held.bits) * 64 < 5 * 20_000
    again = Shard.unpacked(*held.packed())
    assert (again.probe(h, f) == at).all()
    empty = Shard.build(h[:0], f[:0], np.zeros(0, np.uint32), np.zeros(0, np.int64))
    assert (empty.probe(h[:5], f[:5]) == -1).all()


def test_index_counts_are_those_of_the_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = build_index(line_counts(df), shard_keys=20)
    assert index.agg({"n": "sum"}).first()[0] == line_counts(df).where("n > 1 AND top IS NOT NULL").count()
    assert index.count() > 4
