"""Fingerprints and the n-gram join against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from orbitrace.llm import fingerprints as fp
from orbitrace.llm import ngram_join as nj
from orbitrace.llm.text_hash import distinct_shingles

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    w = SPACE.findall(text or "")
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_links(rows, threshold=0.8):
    """Rows: (id, text). Number of linked other rows and the component of each row, as row numbers."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = (rows[i][1] or "") == (rows[j][1] or "")
            if same or (a and b and len(a & b) / len(a | b) >= threshold):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    return links, [find(i) for i in range(len(rows))]


def near_copies(seed=3, groups=6, size=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(100)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(100)] = word()
            out.append(" ".join(w))
    return out + [" ".join(word() for _ in range(60)) for _ in range(20)]


def check_classes(df, rows):
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_links, r.class_id) for r in df.collect()), key=str)
    links, parts = brute_links(rows)
    lead = {}
    for (i, _), p in zip(rows, parts, strict=True):
        key = (i is not None, i or 0)
        lead[p] = min(lead.get(p, key), key)
    want = sorted(((i is not None, i or 0, n, lead[p][1] if lead[p][0] else None) for (i, _), n, p in zip(rows, links, parts, strict=True)), key=str)
    assert got == want


def test_classes_match_brute_force(spark):
    rows = list(enumerate(near_copies()))
    check_classes(nj.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_blocks_and_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 3)
    monkeypatch.setattr(nj, "NODE_ROWS", 4)
    monkeypatch.setattr(nj, "BROADCAST_ROWS", 0)
    rows = list(enumerate(near_copies(seed=9, groups=2, size=14)))
    check_classes(nj.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_classes_with_odd_rows(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_classes(nj.similarity_classes(docs), rows)


def test_one_per_class_stays(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = nj.keep_one_per_class(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_links(rows)[1]))


def test_empty_tables(no_docs):
    assert nj.similarity_classes(no_docs).count() == 0
    assert nj.keep_one_per_class(no_docs).count() == 0
    assert fp.fingerprint_documents(no_docs).count() == 0
    assert fp.near_duplicate_classes(no_docs).count() == 0


def test_stop_depth_meets_target():
    d = nj.stop_depth(0.8, 20, 8, 0.9999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def test_node_links_lose_nothing():
    rng = np.random.RandomState(1)
    base = rng.randint(0, 256, size=(5, 40)).astype(np.uint8)
    rows = np.repeat(base, 12, axis=0)
    rows[rng.rand(*rows.shape) < 0.1] = 7
    order = np.lexsort(rows[:, :8].T[::-1])
    labels = nj.node_links(rows[order][:, :8], rows[order], 0, 0.7)
    want = nj.merge_labels(np.arange(60), *np.nonzero((rows[order][:, None] == rows[order][None]).mean(axis=2) >= 0.7))
    assert np.array_equal(labels, want)


def test_fingerprints_match_brute_force(docs):
    got = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in fp.fingerprint_documents(docs, parts=3).collect()}
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    for k, (some, i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m] if m else text
        r = got[(i if some else None, len(text), hashlib.sha256(edited.encode()).hexdigest())]
        own, changed, follow = (fp.fingerprint_matrix(pa.array([x]))[0] for x in (text, edited, after))
        assert r.fingerprint == own.astype(">u2").tobytes().hex()
        assert r.near_edited == fp.likeness(own, changed)
        assert r.near_next == fp.likeness(own, follow)


def test_likeness_estimates_jaccard():
    a = " ".join(f"w{i}" for i in range(2000))
    b = " ".join(f"w{i}" for i in range(500, 2500))
    m = fp.fingerprint_matrix(pa.array([a, b]))
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs(fp.likeness(m[0], m[1]) - true) < 0.15


def test_shingles_by_hash_are_as_many():
    texts = ["a b c d e f g", "a b c", "", "x  y\tz\n1 2 3 1 2 3 1 2 3", "é è"]
    assert [len(s) for s in distinct_shingles(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_long_regular_words_have_hashes_of_their_own():
    bits = [bin(i).count("1") % 2 for i in range(8192)]
    words = ["".join(p[b ^ flip] for b in bits[:n]) for n in (1024, 2048, 4096, 8192) for p in ("ab", "tr", "xy") for flip in (0, 1)]
    words += ["a" * n for n in range(1, 3000, 7)] + ["ab", "ba"]
    assert len({int(s[0]) for s in distinct_shingles(pa.array(words))}) == len(set(words))
    # a hash does not depend on what else is in the batch
    assert [int(s[0]) for s in distinct_shingles(pa.array(words))] == [int(distinct_shingles(pa.array([w]))[0][0]) for w in words]


def test_texts_of_equal_sets_are_counted_by_row(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 2)
    base = " ".join(f"w{i}" for i in range(30))
    texts = [base, base, base.replace(" ", "  "), base.replace(" ", "\n"), base + " x", base + " x", base + " y", "other words that are few", "other  words that are few"]
    rows = list(enumerate(texts)) + [(0, base), (None, base + " z")]
    check_classes(nj.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), rows)


def check_near(df, rows):
    links, parts = brute_links(rows)
    lead = {}
    for (i, _), p in zip(rows, parts, strict=True):
        lead[p] = min(lead.get(p, (True, 1 << 40)), (i is not None, i or 0))
    want = sorted((str(i), n, str(lead[p][1] if lead[p][0] else None)) for (i, _), n, p in zip(rows, links, parts, strict=True))
    assert sorted((str(r.doc_id), r.n_near, str(r.class_id)) for r in df.collect()) == want


def test_fingerprint_query_verifies_bands(spark, docs, monkeypatch):
    rows = list(enumerate(near_copies(seed=4, groups=3, size=6)))
    rows += [(1000, rows[0][1]), (0, rows[0][1]), (None, rows[7][1] + " tail"), (5, "the same id with another text"), (None, None), (1001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_near(fp.fingerprint_documents(df, parts=3), rows)
    check_near(fp.fingerprint_documents(docs, parts=2), [(r.doc_id, r.text) for r in docs.collect()])


def test_crowded_bands_are_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(fp, "LEAST_BAND_ROWS", 3)
    rows = list(enumerate(near_copies(seed=21, groups=2, size=20)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.class_id): r.n_near for r in fp.near_duplicate_classes(df).collect()}
    links, parts = brute_links(rows)
    assert {i: n for (i, _), n in got.items()} == {i: n for (i, _), n in zip(rows, links, strict=True) if n}
    assert len({c for _, c in got}) == len({p for p, n in zip(parts, links, strict=True) if n})


def test_measured_recall_and_shortened_prefixes(spark):
    """Pairs at and above the threshold, edited everywhere: every link of the brute force is in one class, and few of them meet at
    full depth."""
    rng = random.Random(12)
    rows, n = [], 0
    for _ in range(60):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(60, 160))]
        rows.append((n, " ".join(words)))
        n += 1
        for _ in range(rng.randint(1, 3)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
    shingles = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    links = {(i, j) for i in shingles for j in shingles if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])}
    assert nj.levels(0.8, 20, 8, nj.TARGET) == [8, 6, 4] and len(links) > 60
    got = {r.doc_id: r for r in nj.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    met = sum(got[i].class_id == got[j].class_id for i, j in links)
    assert met / len(links) == 1.0
    assert all(got[i].n_links == sum(i in link for link in links) for i in got)
    # with a lower target the prefix stops earlier, and links between texts far apart may go
    assert nj.levels(0.8, 20, 8, 0.9) == [8, 6] or nj.levels(0.8, 20, 8, 0.9)[-1] >= 5


def test_groups_that_are_linked_stay_so_in_a_node():
    rng = np.random.RandomState(2)
    sketches = rng.randint(0, 255, (30, 64)).astype(np.uint8)
    groups = np.arange(30)
    groups[20:25] = 20
    labels = nj.node_links(sketches[:, :8], sketches, 0, 0.7, groups)
    assert (labels[20:25] == labels[20]).all() and len(set(labels.tolist())) == 26
