"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram vector binds (multiplies) its letters' vectors, each permuted
(rolled) by its place in the n-gram. A text's profile bundles (adds) the vectors of its n-grams, a language's prototype
bundles the profiles of its training texts, and a text is compared with the prototypes by cosine.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches, unused

DIMENSIONS, ALPHABET, SEED = 1024, 64, 977
#: The prototypes that are gathered hold this many languages at most; more raise an error.
MAX_LANGUAGES = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Symbol of every code point: 0 is a word edge (not a letter), a-z are 1 to 26, other lower-cased letters share the rest."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (ALPHABET - 27)
    return table


@lru_cache(maxsize=4)
def letter_vectors(dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return (np.random.RandomState(seed).randint(0, 2, size=(ALPHABET, dimensions)) * 2 - 1).astype(np.float32)


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors of trigram codes ``a * A * A + b * A + c``."""
    base = letter_vectors(dimensions)
    a, b, c = codes // (ALPHABET * ALPHABET), codes // ALPHABET % ALPHABET, codes % ALPHABET
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, code, count)`` of the letter trigrams of each text; runs of other characters are one word edge.

    A trigram has at least one letter. A text without letters has none.
    """
    joined = "\x00\x00" + "\x00\x00".join(texts) + "\x00\x00"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    row = np.repeat(np.arange(len(texts)), lengths + 2)  # of each character after the first two
    sym = letter_table()[chars]
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0)
    keep[:2] = [False, True]
    places = np.flatnonzero(keep)
    s = sym[places].astype(np.int64)
    if len(s) < 3:
        return (np.zeros(0, np.int64),) * 3
    code = (s[:-2] * ALPHABET + s[1:-1]) * ALPHABET + s[2:]
    mid = places[1:-1]
    good = s[1:-1] > 0  # the middle is a letter, so each letter of a text is counted once
    where = row[mid[good] - 2]
    keys, counts = np.unique(where * ALPHABET**3 + code[good], return_counts=True)
    return keys // ALPHABET**3, keys % ALPHABET**3, counts


def profiles(texts: list[str], dimensions: int = DIMENSIONS, slice_rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vectors of the texts, ``(n, dimensions)``, and how many n-grams each holds."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    row, code, count = gram_counts(texts)
    for lo in range(0, len(texts), slice_rows):
        i, j = np.searchsorted(row, [lo, lo + slice_rows])
        if i == j:
            continue
        codes, place = np.unique(code[i:j], return_inverse=True)
        weights = np.zeros((min(slice_rows, len(texts) - lo), len(codes)), dtype=np.float32)
        weights[row[i:j] - lo, place] = count[i:j]
        out[lo : lo + slice_rows] = weights @ gram_vectors(codes, dimensions)
    return out, np.bincount(row, weights=count, minlength=len(texts)).astype(np.int64)


def is_held_out():
    """Column: the CRC-32 of doc_id as text is divisible by 5 (a null id is not held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit_prototypes(training: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from all rows of ``training`` (``text``, ``lang``); null text or lang is left out.

    Every partition bundles its own rows' n-gram counts in whole numbers, so the sum does not depend on the order of the
    tasks. What is gathered is bounded by languages times n-gram codes; the prototypes are bound from these.
    """
    bound_batches(training.sparkSession)

    def count(batches):
        total: dict[str, dict[int, int]] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            row, code, n = gram_counts(batch.column("text").to_pylist())
            names = sorted(set(langs))
            at = np.array([names.index(x) for x in langs], dtype=np.int64)
            keys, place = np.unique(at[row] * ALPHABET**3 + code, return_inverse=True)
            sums = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)
            for key, v in zip(keys.tolist(), sums.tolist(), strict=True):
                mine = total.setdefault(names[key // ALPHABET**3], {})
                mine[key % ALPHABET**3] = mine.get(key % ALPHABET**3, 0) + v
        for lang, grams in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(list(grams), pa.int32()), pa.array(list(grams.values()), pa.int64())],
                names=["lang", "code", "n"],
            )

    counts = training.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, code int, n long")
    summed = counts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # bundle per language in slices of codes: rows are bounded by languages times ALPHABET cubed
    packed = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("grams")).orderBy("lang").limit(MAX_LANGUAGES + 1)
    names, vectors = [], []
    for r in packed.toLocalIterator():
        names.append(r["lang"])
        codes, n = np.array([g["code"] for g in r["grams"]], dtype=np.int64), np.array([g["n"] for g in r["grams"]], dtype=np.float64)
        total = np.zeros(dimensions, dtype=np.float64)
        for lo in range(0, len(codes), 8192):
            total += n[lo : lo + 8192] @ gram_vectors(codes[lo : lo + 8192], dimensions).astype(np.float64)
        vectors.append(total / max(np.linalg.norm(total), 1e-12))
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return names, np.array(vectors, dtype=np.float32).reshape(len(names), dimensions)


def score_languages(
    docs: DataFrame, names: list[str], prototypes: np.ndarray, prediction: str = "lang_pred", score: str = "score", margin: str | None = None
) -> DataFrame:
    """``docs`` with a language and its cosine (0 to 1) per row, from the column ``text`` alone; ``margin``, if named, is
    how far the cosine is above that of the next language (the cosine itself where only one was learned).

    Null text, text without letters, and any text where nothing was learned get ``und`` and 0. Ties take the first
    language in order. All columns of ``docs`` are kept; two of the new names are replaced.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    dimensions = prototypes.shape[1]
    shared = spark.sparkContext.broadcast((names, prototypes))
    made_names = [prediction, score, *([margin] if margin else [])]
    kept = [c for c in docs.columns if c not in made_names]
    kinds = ["string", "double", "double"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` {k}" for c, k in zip(made_names, kinds))])

    def run(batches):
        langs, vectors = shared.value
        for batch in batches:
            made, n = profiles(pc.fill_null(batch.column("text"), "").to_pylist(), dimensions)
            if langs:
                size = np.linalg.norm(made.astype(np.float64), axis=1)
                cosine = (made.astype(np.float64) @ vectors.T.astype(np.float64)) / np.maximum(size, 1e-12)[:, None]
                best = cosine.argmax(axis=1)
                value = np.clip(np.round(cosine[np.arange(len(best)), best], 9), 0, 1)
                label = [langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)]
                others = np.clip(np.sort(cosine, axis=1)[:, -2], 0, 1) if len(langs) > 1 else np.zeros(len(n))
            else:
                value, others, label = np.zeros(len(n)), np.zeros(len(n)), [UNKNOWN] * len(n)
            value, others = np.where(n > 0, value, 0.0), np.where(n > 0, others, 0.0)
            made_columns = [pa.array(label, pa.string()), pa.array(value, pa.float64()), pa.array(value - others, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made_columns[: len(made_names)]], names=[*kept, *made_names])

    return docs.select(*kept).mapInArrow(run, schema)


def identify_languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row, learned from the rows that are not held out.

    Rows that repeat give rows that repeat; extra columns are ignored; an empty table, or one without labels, gives
    ``und`` for what there is.
    """
    names, prototypes = fit_prototypes(docs.where(~is_held_out()), dimensions)
    rows = docs.select("doc_id", "text").withColumn("held_out", is_held_out())
    return score_languages(rows, names, prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, margin: float = 0.1, languages: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text is plainly in one language, and in the one it is labelled with.

    A row goes if its language cannot be told (``und``: null text, or no letter), if the cosine is under ``least`` or
    less than ``margin`` above the next language's (a mix), if its non-null ``lang`` names another language than the
    text, or, where ``languages`` is given, if the language is none of those. A null ``lang`` rejects nothing. Rows that
    repeat stay or go together; all columns are kept in order; an empty table, or one without labels, gives no rows.
    """
    names, prototypes = fit_prototypes(docs.where(~is_held_out()))
    own = unused(docs, "__lang")
    found, score, above = (f"{own}_{k}" for k in ("pred", "score", "margin"))
    told = score_languages(docs, names, prototypes, found, score, above)
    good = (F.col(found) != UNKNOWN) & (F.col(score) >= least) & (F.col(above) >= margin)
    good = good & (F.col("lang").isNull() | (F.col("lang") == F.col(found)))
    if languages is not None:
        good = good & F.col(found).isin(list(languages))
    return told.where(good).drop(found, score, above)
