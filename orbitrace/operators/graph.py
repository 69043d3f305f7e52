"""Connected components over an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.session import discard, materialize

#: Edges that one task contracts at a time, and that a block may hold before it is salted.
CHUNK_EDGES = 1_000_000


def node_ranks(nodes: pa.Array) -> np.ndarray:
    """A whole number for every node, equal for equal nodes and in the order Spark gives them (null fields first)."""
    if pa.types.is_struct(nodes.type):
        out = np.zeros(len(nodes), dtype=np.int64)
        for field in nodes.flatten():
            part = node_ranks(field)
            _, out = np.unique(out * (int(part.max(initial=0)) + 1) + part, return_inverse=True)
        return out
    coded = nodes.dictionary_encode()
    order = np.empty(len(coded.dictionary), dtype=np.int64)
    order[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(order) + 1)
    return np.append(order, 0)[pc.fill_null(coded.indices, len(order)).to_numpy(zero_copy_only=False)]


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of rows after the links ``a[i]-b[i]`` (arrays of row numbers) are added; a label is the smallest one."""
    labels = labels.copy()
    while True:
        low = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]
        if np.array_equal(before, labels):
            return labels


def contract(edges: DataFrame) -> DataFrame:
    """``(u, v)``: every node of a task's edges with the smallest node it reaches within them, which keeps connections.

    Tasks work on at most ``CHUNK_EDGES`` edges at a time, so memory is bounded and a task's result is never more than
    its nodes.
    """
    kind = edges.schema["u"].dataType.simpleString()

    def stars(held: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(held).combine_chunks()
        u, v = whole.column(0), whole.column(1)
        nodes = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks()
        if isinstance(nodes, pa.ChunkedArray):
            nodes = nodes.chunk(0)
        _, first, code = np.unique(node_ranks(nodes), return_index=True, return_inverse=True)
        labels = merge_labels(np.arange(len(first)), code[: len(u)], code[len(u) :])
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(first)), nodes.take(pa.array(first[labels]))], names=["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_EDGES:
                yield stars(held)
                held, n = [], 0
        if n:
            yield stars(held)

    return edges.mapInArrow(run, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, block: str | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; ``component`` is the smallest node it can reach.

    Every task first contracts its own edges to stars. Where ``block`` (an expression over ``u``, the larger end) names
    parts of the graph that no edge leaves, edges are dealt by block and nothing else is needed; crowded blocks are
    salted. What is still no set of stars goes through alternating large-star and small-star steps (Kiveris et al.): partial minima per
    node and equi joins that the skewed-join rule can split, with the result contracted again and written to the scratch
    folder. Null ends and self loops are ignored (a node that has only a self loop is its own component). An empty table
    gives an empty result.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    start = contract(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    cur = materialize(start if block is not None else start.distinct(), "cc")
    if block is not None:
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        most = cur.groupBy(F.expr(block).alias("b")).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
        salt = F.pmod(F.xxhash64("v"), F.lit(-(-most // CHUNK_EDGES) or 1))
        cur = _next(cur, contract(cur.repartition(parts, F.expr(block), salt)))
    for _ in range(max_rounds):
        work = cur.where("u <> v")
        # stars: every node but a centre has one edge, and no centre has one
        ends = work.select("u", "v", F.lit(True).alias("leaf")).union(work.select(F.col("v").alias("u"), F.lit(None), F.lit(False)))
        odd = ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("leaf").alias("all"), F.max("leaf").alias("any"))
        if not odd.where("a <> b OR all <> any").limit(1).count():
            break
        both = work.union(work.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node points to smaller nodes only
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low2.select("u", F.col("m").alias("v")))
        cur = _next(cur, contract(small.where("u <> v").union(cur.where("u = v"))).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = cur.union(cur.select("v", "v"))
    return named.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _next(old: DataFrame, new: DataFrame) -> DataFrame:
    out = materialize(new, "cc")
    discard(old)
    return out
