from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"
WORDS = "der die das and the of la le un que río naïve straße 漢字 it's 10.5 don't \t \n".split(" ")


def rows_of(seed: int = 5, n: int = 60):
    """Texts with copies, near copies, nulls, empty and very long ones, repeated rows and clashing column names."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) + rng.choice(["", "x", "yz"]) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " tail"
    texts += [None, "", "   ", "one", "two words", "no", "x" * 5000, "long " * 20_000, "<|endoftext|>a <|endoftext|>"]
    out = [(i, t, rng.choice(["de", "en", None]), "s", None if t is None else len(t), "k", "w") for i, t in enumerate(texts)]
    out += [out[4], (None, "a null id", "en", None, 9, None, None), (None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
