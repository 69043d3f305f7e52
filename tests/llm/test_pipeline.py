"""The pipeline's stages against the operators' brute-force twins, on a small table and on its edge cases."""

from __future__ import annotations

import random

import corpus_pipeline
from orbitrace.session import materialize
from tests.llm.test_joins import brute_links
from tests.llm.test_text_operators import base_spans, measures


def small_docs(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "ra", "lo"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.randint(40, 160))) for _ in range(30)]
    texts += [texts[0], texts[1] + " end", "a b c " * 50, "# $ % & " * 30, None, "", "1 2 3 " * 3 + " ".join(str(i) for i in range(80))]
    texts.append(texts[2] + " write to x.y@example.com or +49 30 1234567")
    rows = [(i, t, "xx", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_follow_one_another(spark):
    docs = small_docs(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, "unused"), "stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = {name: {r.doc_id: r.text for r in df.collect()} for name, df in seen.items() if name != "packing"}
    every = {r.doc_id: r.text for r in small_docs(spark).collect()}

    def passes(t):
        n, chars, symbols, dup, repeat, lines = measures(t)
        return n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= n and 3 * n <= chars <= 10 * n and 100 * dup <= 50 * lines

    assert rows["quality rules"] == {i: t for i, t in every.items() if passes(t)}
    assert rows["language"] == {i: t for i, t in rows["quality rules"].items() if any(c.isalpha() for c in t)}
    listed = sorted(rows["language"].items())
    _, parts = brute_links(listed)
    first = {}
    for (i, t), p in zip(listed, parts, strict=True):
        first.setdefault(p, (i, t))
    assert rows["near duplicates"] == dict(first.values())
    assert rows["personal data"].keys() == rows["near duplicates"].keys()
    for i, t in rows["personal data"].items():
        assert not any(base_spans(t).values())
        if not any(base_spans(rows["near duplicates"][i]).values()):
            assert t == rows["near duplicates"][i]
    assert {r.doc_id for r in seen["packing"].collect()} == set(rows["personal data"])


def test_run_gives_the_last_stage(spark, tmp_path):
    small_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns


def test_empty_table(spark, tmp_path):
    small_docs(spark).where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
