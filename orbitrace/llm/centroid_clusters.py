"""Centroid clustering by progressive search over Walsh-Hadamard coefficients.

Vectors become whole numbers and then their 64 Walsh-Hadamard coefficients, in the order in which the first ``2^m`` tell the
means of ``2^m`` runs of components. The transform keeps squared distances up to the factor 64 and is exact. A search adds up
squared differences of coefficients from coarse to fine; as they only grow, a centroid whose part is already above a known
whole distance is strictly worse and goes. What is left is worked out over all 64 coefficients.

The coefficients are written once; every round is one pass over them, whose tasks return sums per centroid and nothing per
vector. Sums of coefficients are coefficients of sums, so the new centroids follow from them exactly.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.session import materialize

DIM = 64
#: Ends of the slices of coefficients that a search adds, coarse to fine.
LEVELS = (4, 8, 16, 32, 64)
#: Components below this give coefficients that fit 32 bits and sums of squares that fit 64.
NARROW = 1 << 24
#: Components from here on are refused: their coefficients need not fit 64 bits.
WIDEST = 1 << 56
#: Vectors that are searched at a time.
SLICE = 4096
_PALEY = np.array([int(f"{i:06b}"[::-1], 2) for i in range(DIM)])


def hadamard(values: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients, coarse ones first, along the last axis of 64 whole numbers; twice gives 64 times the values."""
    out, half = values, 1
    while half < DIM:
        pair = out.reshape(*values.shape[:-1], DIM // (2 * half), 2, half)
        a, b = pair[..., 0, :], pair[..., 1, :]
        out = np.stack([a + b, a - b], axis=-2).reshape(values.shape)
        half *= 2
    return out[..., _PALEY]


def nearest_centroids(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller one) and 64 times the squared distance, of rows of coefficients.

    Works on 64-bit or Python integers; the sums must fit.
    """
    n, k = len(coefs), len(centroids)
    kind = coefs.dtype
    part = ((coefs[:, None, : LEVELS[0]] - centroids[None, :, : LEVELS[0]]) ** 2).sum(axis=2)
    guess = part.argmin(axis=1)
    bound = ((coefs - centroids[guess]) ** 2).sum(axis=1)
    alive = part <= bound[:, None]
    for a, b in zip(LEVELS[:-1], LEVELS[1:], strict=True):
        i, j = np.nonzero(alive)
        part[i, j] += ((coefs[i, a:b] - centroids[j, a:b]) ** 2).sum(axis=1)
        alive[i, j] = part[i, j] <= bound[i]
    # those alive have all 64 coefficients in their sum; the first of the least ones wins
    best = np.full(n, k, dtype=np.int64)
    total = bound.astype(kind, copy=True)
    for j in range(k):
        better = alive[:, j].astype(bool) & ((best == k) | (part[:, j] < total))
        best[better], total[better] = j, part[better, j]
    return best, total


def _pack(batches):
    for batch in batches:
        rows = batch.column("v")
        x = np.floor(np.asarray(rows.flatten(), dtype=np.float64).reshape(-1, DIM) * 1024.0)
        if len(x) and np.abs(x).max() >= WIDEST:
            raise ValueError("a component of 2^46 or more: squared distances would not be 64-bit numbers")
        wide = (np.abs(x) >= NARROW).any(axis=1)
        coefs = hadamard(x.astype(np.int64))
        packed = [c.tobytes() if w else c.astype(np.int32).tobytes() for c, w in zip(coefs, wide, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "coefs"])


def vector_coefficients(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id`` and the packed coefficients of the vectors with 64 components, none of them null, NaN or infinite."""
    whole = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where((F.size(column) == DIM) & whole).select("vec_id", F.col(column).cast("array<double>").alias("v"))
    kind = dict(vectors.dtypes)["vec_id"]
    return kept.mapInArrow(_pack, f"vec_id {kind}, coefs binary")


def _searched(batch: pa.RecordBatch, centroids: list[list[int]]):
    """Slices ``rows, coefs, best, total`` of a batch of packed coefficients."""
    column = batch.column("coefs")
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
    packed = column.to_pylist()
    far = max((abs(c) for row in centroids for c in row), default=0) >= DIM * NARROW
    for wide in (False, True):
        rows = np.flatnonzero((lengths == 8 * DIM) == wide)
        for a in range(0, len(rows), SLICE):
            some = rows[a : a + SLICE]
            coefs = np.frombuffer(b"".join(packed[i] for i in some), np.int64 if wide else np.int32).reshape(-1, DIM).astype(np.int64)
            if wide or far:
                coefs = coefs.astype(object)
            best, total = nearest_centroids(coefs, np.array(centroids, dtype=coefs.dtype))
            yield some, coefs, best, total


def _sums_of(centroids: list[list[int]]):
    """A task's sums per centroid: of coefficients (``dim`` 0 to 63), vectors (64) and 64 times the squared distances (65)."""

    def add(batches):
        k = len(centroids)
        sums = [[0] * (DIM + 2) for _ in range(k)]
        for batch in batches:
            for _, coefs, best, total in _searched(batch, centroids):
                for j in range(k):
                    own = best == j
                    if own.any():
                        found = [*coefs[own].sum(axis=0).tolist(), int(own.sum()), sum(total[own].tolist())]
                        sums[j] = [a + b for a, b in zip(sums[j], found, strict=True)]
        rows = [(j, d, Decimal(s)) for j in range(k) for d, s in enumerate(sums[j]) if sums[j][DIM]]
        c, d, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(s, pa.decimal128(38, 0))], names=["cluster", "dim", "total"])

    return add


def _assign(centroids: list[list[int]]):
    def place(batches):
        for batch in batches:
            n = batch.num_rows
            cluster, distance = np.zeros(n, np.int32), [0] * n
            for rows, _, best, total in _searched(batch, centroids):
                cluster[rows] = best
                for i, t in zip(rows.tolist(), total.tolist(), strict=True):
                    distance[i] = t // DIM
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    return place


def _round(coefs: DataFrame, centroids: list[list[int]]) -> dict[int, list[int]]:
    """The sums per centroid that has vectors: at most 66 numbers for each, whatever the number of vectors."""
    made = coefs.select("coefs").mapInArrow(_sums_of(centroids), "cluster int, dim int, total decimal(38,0)")
    out: dict[int, list[int]] = {}
    for r in made.groupBy("cluster", "dim").agg(F.sum("total").alias("total")).collect():
        out.setdefault(r.cluster, [0] * (DIM + 2))[r.dim] = int(r.total)
    return out


def moved(centroids: list[list[int]], sums: dict[int, list[int]]) -> list[list[int]]:
    """Coefficients of the componentwise floor of the means; a centroid without vectors stays."""
    out = [list(c) for c in centroids]
    for j, s in sums.items():
        components = [c // DIM for c in hadamard(np.array(s[:DIM], dtype=object)).tolist()]
        out[j] = hadamard(np.array([c // s[DIM] for c in components], dtype=object)).tolist()
    return out


def cluster_vectors(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, column: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that is kept.

    Kept are vectors of 64 components, none null, NaN or infinite; a component x becomes floor(1024 x). The first centroids are
    the ``k`` kept vectors (fewer if there are no more) with the smallest SHA-256 of ``seed:vec_id``, rows of one id in the
    order of their components, null ids last. Each round assigns every vector to the nearest centroid, ties to the smaller
    number, and moves every centroid that has vectors to the floor of their mean. ``distance`` is squared. Rows that repeat
    count as often as they occur; extra columns are ignored; without a kept vector the result is empty. A component of
    2^46 or more, or a squared distance or sum of them above 64 bits, raises an error.
    """
    coefs = materialize(vector_coefficients(vectors, column), "coefs")
    named = coefs.withColumn("__h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    # k rows
    first = named.orderBy(F.asc_nulls_last("__h"), "coefs").limit(k).select("coefs").collect()
    centroids = [np.frombuffer(r.coefs, np.int64 if len(r.coefs) == 8 * DIM else np.int32).tolist() for r in first]
    for _ in range(rounds):
        centroids = moved(centroids, _round(coefs, centroids))
    inertia = {j: s[DIM + 1] // DIM for j, s in _round(coefs, centroids).items()}
    whole = sum(inertia.values())
    if whole >= 1 << 63:
        raise ValueError("the sum of squared distances does not fit 64 bits")
    out = coefs.mapInArrow(_assign(centroids), f"vec_id {dict(coefs.dtypes)['vec_id']}, cluster int, distance long")
    digests = []
    for c in centroids:
        components = [x // DIM for x in hadamard(np.array(c, dtype=object)).tolist()]
        digests.append(hashlib.sha256(",".join(map(str, components)).encode()).hexdigest())
    if not centroids:
        digests = [""]
    own = F.element_at(F.array(*(F.lit(inertia.get(j, 0)).cast("long") for j in range(len(digests)))), F.col("cluster") + 1)
    digest = F.element_at(F.array(*map(F.lit, digests)), F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(whole).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
