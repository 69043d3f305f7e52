"""Document fingerprints: MinHash over word shingles.

A signature holds, for each of ``k`` universal hash permutations, the smallest permuted hash of the text's shingles,
worked out in numpy for a whole Arrow batch at once. The printed fingerprint keeps 16 scrambled bits per permutation.
Signatures are also cut into bands; texts that share a band meet in Spark, and their exact Jaccard is then verified.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches
from orbitrace.llm.ngram_join import linked_texts
from orbitrace.llm.text_hash import minhash, mix64, scramble, shingle_hashes
from orbitrace.session import discard, materialize

PERMUTATIONS = 128
#: Bands and their rows: a pair at 0.8 shares one with probability 0.99995.
BANDS, BAND_ROWS = 25, 5
#: Bands that are looked at as possibly crowded; of these, the crowded ones are salted.
HOT_BANDS = 64
#: Rows of a salted part of a band at least, however many tasks there are.
LEAST_BAND_ROWS = 1000
#: Characters of a text that order rows of one id, before the text's MD5.
TIE_CHARS = 32


def fingerprint_matrix(texts: pa.Array, k: int = PERMUTATIONS, width: int = 5) -> np.ndarray:
    """``(n, k)`` 16-bit fingerprint slots of the texts (null: empty); texts without words share one value."""
    values, offsets = shingle_hashes(texts, width)
    return scramble(minhash(values, offsets, k), 16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, an estimate of the Jaccard similarity of the shingle sets."""
    return (a == b).mean(axis=-1)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter (floor) of code points replaced by the first as many of ``following``."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m] if m else text


def id_cuts(docs: DataFrame, parts: int) -> list[float]:
    """Cuts of doc_id into ranges with about equal row counts."""
    found = docs.select(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], F.lit(10_000)).alias("c")).first().c
    return sorted({float(c) for c in found or []})


def _buckets(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` with ``__bucket``: the range of doc_id between ``cuts``, -1 for null ids."""
    from pyspark.ml.feature import Bucketizer

    if cuts:
        split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__id", outputCol="__bucket", handleInvalid="keep")
        rows = split.transform(rows.withColumn("__id", F.col("doc_id").cast("double"))).drop("__id")
    else:
        rows = rows.withColumn("__bucket", F.lit(0))
    return rows.withColumn("__bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__bucket").cast("int")))


def band_hashes(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(n, bands)`` 64-bit hashes of the bands of a signature matrix."""
    cells = minima[:, : bands * rows].reshape(len(minima), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15), cells.shape[:2]).copy()
    for r in range(rows):
        out = mix64(out + cells[:, :, r])
    return out


def banded_texts(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, width: int = 5) -> DataFrame:
    """One row per distinct text, written: ``key`` (MD5), ``node`` (64 bits of it), ``rep`` (its smallest doc_id, null
    before all), ``copies`` and its ``bands``; a text without words has none."""

    def sign(batches):
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            values, off = shingle_hashes(text, width)
            made = band_hashes(minhash(values, off, PERMUTATIONS), bands, rows).view(np.int64).tolist()
            full = np.diff(off) > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([hashlib.md5(t.encode()).digest() for t in text.to_pylist()], pa.binary()),
                    pa.array([x if ok else [] for x, ok in zip(made, full, strict=True)], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "bands"],
            )

    signed = docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, key binary, bands array<long>")
    # the bands depend on the key alone, so any copy's serve
    one = signed.groupBy("key").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null"), F.count("*").alias("copies"), F.first("bands").alias("bands")
    )
    return materialize(one.select("key", F.xxhash64("key").alias("node"), F.when(~F.col("has_null"), F.col("low")).alias("rep"), "copies", "bands"), "banded")


def band_edges(texts: DataFrame) -> DataFrame:
    """Edges ``src, dst`` that join the texts of every band into a star.

    A band is streamed through one task, which holds nothing but its first text. A crowded band is salted: each of its
    stars is then also joined to a node that stands for the band.
    """
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.select(F.explode("bands").alias("band"), "node")
    # a bounded sketch of the most frequent bands; it decides where rows are salted, and nothing else
    top = rows.agg(F.expr(f"approx_top_k(band, {HOT_BANDS}, 10000)").alias("top"), F.count("*").alias("n")).first()
    most = max(LEAST_BAND_ROWS, (top.n or 0) // (2 * parts))
    hot = {r["item"]: -(-r["count"] // most) for r in top.top or [] if r["count"] > most}
    salts = F.lit(1)
    for band, n in hot.items():
        salts = F.when(F.col("band") == band, n).otherwise(salts)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), salts).cast("int")).repartition(parts, "band", "salt").sortWithinPartitions("band", "salt", "node")

    def star(batches):
        at, first = None, 0
        for batch in batches:
            band, node, salt = (batch.column(c).to_numpy() for c in ("band", "node", "salt"))
            new = np.ones(len(band), dtype=bool)
            new[1:] = (band[1:] != band[:-1]) | (salt[1:] != salt[:-1])
            if len(band):
                new[0] = at != (band[0], salt[0])
                heads = np.where(new, np.arange(len(band)), -1)
                heads = np.maximum.accumulate(heads)
                to = np.where(heads < 0, first, node[np.maximum(heads, 0)])
                at, first = (band[-1], salt[-1]), to[-1]
                far = np.flatnonzero(to != node)
                src, dst = node[far], to[far]
                crowded = np.flatnonzero(new & np.isin(band, list(hot))) if hot else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([src, node[crowded]]), pa.int64()), pa.array(np.concatenate([dst, band[crowded]]), pa.int64())], names=["src", "dst"]
                )

    return dealt.mapInArrow(star, "src long, dst long")


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """``doc_id, key, class_id, n_near`` of the rows that are near another one, written; each id and text once.

    Texts that share a band are candidates; candidate groups are verified by exact Jaccard of at least ``threshold`` in
    blocks. ``n_near`` counts the other rows linked to a row (equal texts are), ``class_id`` is the smallest doc_id that
    can be reached over links, null before all. Null text counts as empty. Nothing is capped.
    """
    texts = banded_texts(docs, width=width)
    linked = linked_texts(docs, texts, band_edges(texts), threshold, width, "node")
    near = texts.select("key", "rep", "copies").join(linked, "key", "left").where("copies > 1 OR n_links > 0")
    near = near.select("key", "rep", F.coalesce("component", "key").alias("component"), F.coalesce("n_links", F.col("copies") - 1).alias("n_near"))
    near = materialize(near, "near")
    head = near.groupBy("component").agg(F.min(F.struct(F.col("rep").isNotNull(), F.col("rep").alias("rep"))).alias("head"))
    named = near.join(head, "component").select("key", F.col("head.rep").alias("class_id"), "n_near")
    rows = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"))
    out = materialize(rows.join(named, "key").distinct().select("doc_id", "key", "class_id", "n_near"), "classes")
    for done in (texts, linked, near):
        discard(done)
    return out


def with_next_text(docs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """Rows ``(__bucket, __ahead, doc_id, text, key, class_id, n_near)`` dealt by bucket and sorted, so that each row is
    followed by the next document in ascending doc_id; the first document of the following bucket ends a bucket, marked
    ``__ahead``. Texts travel deflated; a row of ``classes`` has no text and comes before the documents of its id.

    Only the first row of each of at most ``parts + 1`` buckets travels twice.
    """
    spark = docs.sparkSession
    cuts = id_cuts(docs, parts)
    tie, key = F.substring("text", 1, TIE_CHARS), F.unhex(F.md5("text"))
    base = _buckets(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), cuts)
    # of the rows with a null id, the smallest text leads
    null_lead = F.min(F.when(F.col("doc_id").isNull(), F.struct(tie.alias("tie"), key.alias("key"))))
    heads = base.groupBy("__bucket").agg(F.min("doc_id").alias("__first"), null_lead["key"].alias("__first_key")).orderBy("__bucket").limit(parts + 1).collect()
    n = len(heads)
    ring = [(h["__bucket"], h["__first"], h["__first_key"], heads[(k - 1) % n]["__bucket"]) for k, h in enumerate(heads)]
    # at most parts + 1 rows, whatever the input
    ring_df = F.broadcast(spark.createDataFrame(ring, "__bucket int, __first long, __first_key binary, __before int"))
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("ahead"))
    lead = F.struct(F.col("__before").alias("b"), F.lit(True).alias("ahead"))
    leads = (F.col("doc_id") == F.col("__first")) | (F.col("doc_id").isNull() & (key == F.col("__first_key")))
    copies = F.when(leads, F.array(own, lead)).otherwise(F.array(own))
    rows = base.join(ring_df, "__bucket").select(F.explode(copies).alias("c"), "doc_id", tie.alias("__tie"), key.alias("key"), "text").select(F.col("c.b").alias("__bucket"), F.col("c.ahead").alias("__ahead"), "doc_id", "__tie", "key", "text")
    kinds = "__bucket int, __ahead boolean, doc_id long, __tie string, key binary, text binary"

    def deflate(batches):
        for batch in batches:
            packed = [zlib.compress(t.encode(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(packed, pa.binary())], names=batch.schema.names)

    told = _buckets(classes, cuts).select(
        "__bucket", F.lit(False).alias("__ahead"), "doc_id", F.lit(None).cast("string").alias("__tie"), "key", F.lit(None).cast("binary").alias("text"), "class_id", "n_near"
    )
    blank = F.lit(None).cast("long")
    every = rows.mapInArrow(deflate, kinds).select("*", blank.alias("class_id"), blank.alias("n_near")).unionByName(told)
    return (
        every.repartition(parts, "__bucket")
        .sortWithinPartitions("__bucket", "__ahead", F.asc_nulls_first("doc_id"), F.asc_nulls_first("__tie"), "key")
        .drop("__tie")
    )


def fingerprint_documents(docs: DataFrame, k: int = PERMUTATIONS, width: int = 5, parts: int | None = None, threshold: float = 0.8) -> DataFrame:
    """Fingerprint of every text and of its edited text, with their likeness and that to the next document, and the class
    of near duplicates.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id,
    n_near``, one row per input row; the last two are those of ``near_duplicate_classes`` (a row near no other is its
    own class and has 0). Null text counts as empty; null ids come first in the order; rows that repeat an id are
    ordered by the beginning of their text, then its MD5. Texts of fewer than ``width`` words have one shingle, texts
    without words share the empty fingerprint. A lone document is its own next. Other columns of ``docs`` are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, class_id long, n_near long"
    )

    def report(rows: list[tuple]) -> pa.RecordBatch:
        """``rows``: (doc_id, text, class, near rows, next text)."""
        texts = [r[1] for r in rows]
        nexts = [r[4] for r in rows]
        edited = [edited_text(t, x) for t, x in zip(texts, nexts, strict=True)]
        own = fingerprint_matrix(pa.array(texts, pa.large_string()), k, width)
        changed = fingerprint_matrix(pa.array(edited, pa.large_string()), k, width)
        # within a run each next text is the following row's own text
        follow = np.empty_like(own)
        follow[:-1] = own[1:]
        odd = [i for i in range(len(rows)) if i + 1 == len(rows) or nexts[i] is not texts[i + 1]]
        follow[odd] = fingerprint_matrix(pa.array([nexts[i] for i in odd], pa.large_string()), k, width)
        big = ">u2"
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in own.astype(big)], pa.string()),
                pa.array([x.tobytes().hex() for x in changed.astype(big)], pa.string()),
                pa.array(likeness(own, changed), pa.float64()),
                pa.array(likeness(own, follow), pa.float64()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id", "n_near"],
        )

    def walk(batches):
        held = None  # (bucket, (doc_id, text, class, near rows)) still without its next text
        told = {}  # key -> class and near rows: the class rows just read
        documents = True
        for batch in batches:
            ready = []
            for bucket, ahead, doc_id, key, packed, class_id, n_near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if packed is None:
                    if documents:
                        told, documents = {}, False
                    told[doc_id, key] = (class_id, n_near)
                    continue
                documents = True
                text = zlib.decompress(packed).decode()
                if held is not None and held[0] == bucket:
                    ready.append((*held[1], text))
                    held = None
                if not ahead:
                    held = (bucket, (doc_id, text, *told.get((doc_id, key), (doc_id, 0))))
            if ready:
                yield report(ready)

    return with_next_text(docs, near_duplicate_classes(docs, threshold, width), parts).mapInArrow(walk, schema)
