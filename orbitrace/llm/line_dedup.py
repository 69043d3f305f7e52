"""Line deduplication through a sharded minimal perfect hash.

A first pass counts the documents of every line key, as 128 bits of hash. The keys that more than one document holds are dealt
into shards by their hash; a task builds a minimal perfect hash over each shard: bit arrays of shrinking levels, in which a
key that is alone at its place is settled, and whose rank is the key's index. Under that index stand a fingerprint (the
second half of the hash), the count of documents and the largest doc_id. A second pass over the documents probes these
arrays; no line is joined. A small index is broadcast after its size is measured. Above that bound the hashes, not the
lines, are sent to the shards, and only what is to be dropped comes back.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.llm.batches import bound_batches
from orbitrace.llm.text_hash import mix64
from orbitrace.session import materialize

#: A line's key is stripped of these bytes at both ends.
BLANK = b" \t\n\x0b\x0c\r"
#: Keys of a shard on average at most, and bits of a level for each of its keys.
SHARD_KEYS, GAMMA = 1 << 15, 2
#: Bytes of an index that may be broadcast.
BROADCAST_BYTES = 64 << 20
#: Line hashes for one task at most on average, where they are sent to the shards.
ROUTED_ROWS = 1 << 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def line_hash(line: bytes, least_chars: int) -> bytes | None:
    """16 bytes of hash of a line's key, or None where the key has fewer than ``least_chars`` code points."""
    key = line.strip(BLANK)
    if len(key) < least_chars or (len(key) < 4 * least_chars and not key.isascii() and len(key.decode()) < least_chars):
        return None
    return hashlib.blake2b(key.lower(), digest_size=16).digest()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return pc.fill_null(batch.column("text"), "").cast(pa.binary()).to_pylist()


def _places(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(h ^ mix64(f + np.uint64((level + 1) * int(_SEED) & 0xFFFFFFFFFFFFFFFF))) % np.uint64(size)).astype(np.int64)


@dataclass
class Shard:
    """Minimal perfect hash of one shard and the arrays under it."""

    sizes: list[int]
    bits: np.ndarray
    fingerprint: np.ndarray
    count: np.ndarray
    top: np.ndarray

    def __post_init__(self):
        self.base = np.cumsum([0, *self.sizes]).astype(np.int64)
        ones = np.bitwise_count(self.bits)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])

    @classmethod
    def build(cls, h: np.ndarray, f: np.ndarray, count: np.ndarray, top: np.ndarray) -> Shard:
        """From distinct pairs of hashes; the levels end when every key is settled."""
        sizes, words, order = [], [], []
        left = np.arange(len(h))
        while len(left):
            size = -(-GAMMA * len(left) // 64) * 64
            at = _places(h[left], f[left], len(sizes), size)
            held = np.bincount(at, minlength=size)
            alone = held[at] == 1
            full = np.zeros(size, np.uint8)
            full[at[alone]] = 1
            words.append(np.packbits(full, bitorder="little").view(np.uint64))
            settled = left[alone]
            order.append(settled[np.argsort(at[alone])])
            sizes.append(size)
            left = left[~alone]
        index = np.concatenate(order) if order else np.zeros(0, np.int64)
        bits = np.concatenate(words) if words else np.zeros(0, np.uint64)
        return cls(sizes, bits, f[index], count[index], top[index])

    def probe(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Index of every pair of hashes, -1 for those that are not in the shard."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = _places(h[open_], f[open_], level, size) + self.base[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit & np.uint64(1)).astype(bool)
            w, b = word[hit], bit[hit]
            out[open_[hit]] = self.before[w] + np.bitwise_count(self.bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            open_ = open_[~hit]
        found = out >= 0
        found[found] = self.fingerprint[out[found]] == f[found]
        return np.where(found, out, -1)

    def packed(self) -> tuple[list[int], bytes, bytes, bytes, bytes]:
        return self.sizes, self.bits.tobytes(), self.fingerprint.tobytes(), self.count.tobytes(), self.top.tobytes()

    @classmethod
    def unpacked(cls, sizes, bits, fingerprint, count, top) -> Shard:
        return cls(list(sizes), np.frombuffer(bits, np.uint64), np.frombuffer(fingerprint, np.uint64), np.frombuffer(count, np.uint32), np.frombuffer(top, np.int64))


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(h + _SEED) % np.uint64(shards)).astype(np.int32)


def line_counts(docs: DataFrame, least_chars: int = 40) -> DataFrame:
    """``h, f, n, top`` of every key: its hash in two halves, the documents that hold it and the largest doc_id of these."""

    def keys(batches):
        for batch in batches:
            ids, rows, hashes = batch.column("doc_id"), [], []
            for i, text in enumerate(_texts(batch)):
                own = {line_hash(x, least_chars) for x in text.split(b"\n")}
                own.discard(None)
                hashes.extend(own)
                rows.extend([i] * len(own))
            h, f = _halves(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f.view(np.int64)), ids.take(pa.array(rows, pa.int64()))], names=["h", "f", "doc_id"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(keys, "h long, f long, doc_id long")
    return found.groupBy("h", "f").agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))


def build_index(counts: DataFrame, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """One written row per shard of the keys of two documents or more: ``shard, shards, n, held`` and the arrays.

    A key of one document never loses a line, so it has no entry. A shard holds ``shard_keys`` keys on average, by hash, so
    a task's memory does not grow with the corpus.
    """
    kept = materialize(counts.where("n > 1 AND top IS NOT NULL"), "line_keys")
    shards = max(1, -(-kept.count() // shard_keys))
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def numbered(batches):
        for batch in batches:
            shard = _shard_of(np.asarray(batch.column("h")).view(np.uint64), shards)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], names=["shard", *batch.schema.names])

    def build(batches):
        def made(parts):
            h, f, n, top = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("h", "f", "n", "top"))
            held = Shard.build(h.view(np.uint64), f.view(np.uint64), np.minimum(n, 0xFFFFFFFF).astype(np.uint32), top.astype(np.int64))
            row = (parts[0].column("shard")[0].as_py(), shards, len(h), int(n.sum()), *held.packed())
            names = ["shard", "shards", "n", "held", "sizes", "bits", "fingerprint", "count", "top"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column("shard"))
            edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b > a:
                    if waiting and waiting[0].column("shard")[0].as_py() != shard[a]:
                        yield made(waiting)
                        waiting = []
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield made(waiting)

    schema = "shard int, shards int, n long, held long, sizes array<int>, bits binary, fingerprint binary, count binary, top binary"
    dealt = kept.mapInArrow(numbered, "shard int, h long, f long, n long, top long").repartition(min(parts, shards), "shard").sortWithinPartitions("shard")
    return materialize(dealt.mapInArrow(build, schema), "line_index")


def _digested(ids: pa.Array, rows: list[tuple[int, int, bytes]], texts: bool) -> pa.RecordBatch:
    arrays = [ids, pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())]
    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    if texts:
        arrays.append(pa.array([r[2].decode() for r in rows], pa.string()))
        names.append("kept_text")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _probed(shards: dict[int, Shard], total: int, hashes: list[bytes], ids: np.ndarray, known: np.ndarray, least_docs: int) -> np.ndarray:
    """Which of the hashes are those of lines to drop from the document beside each of them."""
    h, f = _halves(hashes)
    out = np.zeros(len(h), bool)
    own = _shard_of(h, total)
    order = np.argsort(own, kind="stable")
    edges = np.flatnonzero(np.diff(own[order])) + 1
    for rows in np.split(order, edges) if len(order) else ():
        held = shards.get(int(own[rows[0]]))
        if held is not None:
            at = held.probe(h[rows], f[rows])
            rows, at = rows[at >= 0], at[at >= 0]
            out[rows] = (held.count[at] >= least_docs) & ~(known[rows] & (held.top[at] == ids[rows]))
    return out


def _dropped_here(index: DataFrame, docs: DataFrame, total: int, least_docs: int, least_chars: int, texts: bool, schema: str) -> DataFrame:
    """The second pass with the whole index in every worker."""
    spark = docs.sparkSession
    # bounded: its size was measured against BROADCAST_BYTES
    packed = [(r.shard, r.sizes, bytes(r.bits), bytes(r.fingerprint), bytes(r["count"]), bytes(r.top)) for r in index.drop("shards", "n", "held").collect()]
    shared = spark.sparkContext.broadcast(packed)

    def probe(batches):
        shards = {s: Shard.unpacked(*arrays) for s, *arrays in shared.value}
        for batch in batches:
            ids, lines = batch.column("doc_id"), [t.split(b"\n") for t in _texts(batch)]
            hashes = [[line_hash(x, least_chars) for x in own] for own in lines]
            flat = [x for own in hashes for x in own if x is not None]
            counts = [sum(x is not None for x in own) for own in hashes]
            known = np.repeat(np.asarray(ids.is_valid()), counts)
            go = iter(_probed(shards, total, flat, np.repeat(np.asarray(pc.fill_null(ids, 0)), counts), known, least_docs).tolist())
            rows = []
            for own, keys in zip(lines, hashes, strict=True):
                kept = [x for x, key in zip(own, keys, strict=True) if key is None or not next(go)]
                rows.append((len(own), len(own) - len(kept), b"\n".join(kept)))
            yield _digested(ids, rows, texts)

    return docs.mapInArrow(probe, schema)


def _dropped_by_routes(index: DataFrame, docs: DataFrame, total: int, least_docs: int, least_chars: int, texts: bool, schema: str) -> DataFrame:
    """The second pass with hashes sent to the shards: a shard's arrays come first in its task, then hashes stream by.

    A shard with many rows is salted, and its arrays go to every salt. What returns to a document is the set of its hashes
    to drop, under its id and the digest of its text.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = F.greatest(F.lit(1), F.ceil(F.col("held") / ROUTED_ROWS)).cast("int")
    arrays = ["sizes", "bits", "fingerprint", "count", "top"]
    empty = {"sizes": "array<int>", "bits": "binary", "fingerprint": "binary", "count": "binary", "top": "binary"}
    sent = index.withColumn("salts", salts).select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *arrays, *(F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("digest", "binary"), ("hashes", "binary"))))

    def keys(batches):
        for batch in batches:
            rows, shards, found, texts = [], [], [], _texts(batch)
            for i, text in enumerate(texts):
                own = {line_hash(x, least_chars) for x in text.split(b"\n")}
                own.discard(None)
                if own:
                    own = sorted(own)
                    for s, x in zip(_shard_of(_halves(own)[0], total).tolist(), own, strict=True):
                        rows.append(i)
                        shards.append(s)
                        found.append(x)
            digests = [hashlib.md5(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([digests[i] for i in rows], pa.binary()), pa.array(found, pa.binary())],
                names=["shard", "doc_id", "digest", "hashes"],
            )

    lines = docs.mapInArrow(keys, "shard int, doc_id long, digest binary, hashes binary").distinct()
    lines = lines.join(F.broadcast(index.select("shard", salts.alias("salts"))) if total <= 100_000 else index.select("shard", salts.alias("salts")), "shard")
    lines = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "digest"), F.col("salts")).cast("int"))
    lines = lines.select("shard", "salt", *(F.lit(None).cast(empty[c]).alias(c) for c in arrays), "doc_id", "digest", "hashes")

    def probe(batches):
        held, at = None, None
        for batch in batches:
            shard, first = np.asarray(batch.column("shard")), np.flatnonzero(np.asarray(batch.column("hashes").is_null()))
            for a, b in zip([0, *first.tolist()], [*first.tolist(), len(shard)], strict=True):
                part = batch.slice(a, b - a)
                if b > a and a in first:
                    at, held = int(shard[a]), Shard.unpacked(*(part.column(c)[0].as_py() for c in arrays))
                    part = part.slice(1)
                if part.num_rows:
                    ids = part.column("doc_id")
                    go = _probed({at: held}, total, part.column("hashes").to_pylist(), np.asarray(pc.fill_null(ids, 0)), np.asarray(ids.is_valid()), least_docs)
                    yield part.select(["doc_id", "digest", "hashes"]).filter(pa.array(go))

    dealt = sent.unionByName(lines).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("hashes").isNotNull())
    hits = dealt.mapInArrow(probe, "doc_id long, digest binary, hashes binary").groupBy("doc_id", "digest").agg(F.collect_list("hashes").alias("go"))
    keyed = docs.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    hits = hits.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), "go")
    joined = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("doc_id", "text", "go")

    def drop(batches):
        for batch in batches:
            rows = []
            for text, go in zip(_texts(batch), batch.column("go").to_pylist(), strict=True):
                own, gone = text.split(b"\n"), set(go or ())
                kept = [x for x in own if not gone or line_hash(x, least_chars) not in gone]
                rows.append((len(own), len(own) - len(kept), b"\n".join(kept)))
            yield _digested(batch.column("doc_id"), rows, texts)

    return joined.mapInArrow(drop, schema)


def drop_repeated_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, texts: bool = False, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of every row, and ``kept_text`` if ``texts``.

    A text is split at newlines; null and empty texts are one empty line. A line's key is the line without blanks at its
    ends, A-Z in lower case. Keys of at least ``least_chars`` code points that ``least_docs`` documents hold lose all their
    lines, but for those in the largest doc_id that holds them. The lines that stay are joined by newlines.

    A document is a row: rows that repeat count as often as they occur, and all rows of the largest doc_id keep the line.
    A row with a null id counts too, but is never the largest, so a key of rows without ids only keeps its lines. Extra
    columns are ignored; an empty table gives an empty result. Keys are compared as 128 bits of hash.
    """
    if least_docs < 2:
        raise ValueError("a line of one document is always that document's last one")
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    index = build_index(line_counts(docs, least_chars), shard_keys)
    size = index.agg(F.sum(F.octet_length("bits") + F.octet_length("fingerprint") + F.octet_length("count") + F.octet_length("top")).alias("b"), F.max("shards").alias("s")).first()
    schema = "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + (", kept_text string" if texts else "")
    way = _dropped_here if (size.b or 0) <= broadcast_bytes else _dropped_by_routes
    return way(index, docs, size.s or 1, least_docs, least_chars, texts, schema)
