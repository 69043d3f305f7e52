"""Minimax contiguous sharding.

Rows are put into ordered atomic groups: a group is a cell of the text hash, so equal texts are always together. The
smallest feasible capacity of a contiguous partition of the group sizes is found by binary search with a greedy check,
and the order is cut there. A group above that capacity is a shard by itself, so it does not set the size of the others.
The number of cells is a parameter, so what the driver plans on does not grow with the data.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 16
#: Rows that one ranking group may hold on average at most.
SALT_ROWS = 50_000


def cuts_for(totals: list[int], capacity: int) -> list[int]:
    """Ends (exclusive) of the greedy shards over running totals, each of at most ``capacity`` or of a single group."""
    ends, at, base = [], 0, 0
    while at < len(totals):
        at = max(at + 1, bisect_right(totals, base + capacity, at))
        ends.append(at)
        base = totals[at - 1]
    return ends


def split_largest(totals: list[int], ends: list[int], shards: int) -> list[int]:
    """``ends`` with the largest run of several groups halved until there are ``shards`` runs or no such run is left."""
    held = [0, *totals]
    runs = [(held[a] - held[b], a, b) for a, b in pairwise([0, *ends]) if b - a > 1]
    heapify(runs)
    out = list(ends)
    while runs and len(out) < shards:
        _, a, b = heappop(runs)
        half = (held[a] + held[b]) / 2
        k = bisect_left(held, half, a + 1, b - 1)
        if k - 1 > a and half - held[k - 1] < held[k] - half:
            k -= 1
        out.append(k)
        for x, y in ((a, k), (k, b)):
            if y - x > 1:
                heappush(runs, (held[x] - held[y], x, y))
    return sorted(out)


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """Smallest capacity with which the ordered ``sizes`` fit into ``shards`` contiguous runs, and the ends of the runs.

    The search is for the smallest capacity of the runs of several groups, where a larger group is a run by itself. As
    every partition has a run that holds such a group, the largest run is still the smallest possible one.
    """
    totals = list(accumulate(sizes))
    if not totals:
        return 0, []
    low, high = 0, totals[-1]
    while low < high:
        mid = (low + high) // 2
        if len(cuts_for(totals, mid)) <= shards:
            high = mid
        else:
            low = mid + 1
    return max(low, max(sizes)), split_largest(totals, cuts_for(totals, low), shards)


def shard_documents(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, under the law ``bytes``.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Shards hold near equal sizes; equal texts, with null and
    empty as one, share a shard. ``slot`` is the place in the shard, from 0 without gaps, in the order of cell, salt,
    doc_id (null first) and checksum; rows that repeat take slots of their own. ``grown_shard`` is null under this law.
    Extra columns are ignored; an empty table gives an empty result. A group larger than a fair share stays whole, in a
    shard by itself where the order has shards to spare, and the other shards hold near equal sizes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(cells)).cast("int").alias("cell"),
    )
    # at most `cells` rows
    book = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("cell").limit(cells).collect()
    _, ends = minimax_cuts([r["size"] for r in book], shards)
    # a ranking group holds at most half of an even task's rows; only the cells above that are salted
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(1, min(SALT_ROWS, sum(r["n"] for r in book) // (2 * parts)))
    plan, lo = [], 0
    for shard, hi in enumerate(ends):
        base = 0
        for r in book[lo:hi]:
            plan.append((r["cell"], shard, base, -(-r["n"] // most)))
            base += r["n"]
        lo = hi
    # at most `cells` rows
    plan_df = F.broadcast(spark.createDataFrame(plan, "cell int, shard int, cell_base long, salts int"))
    salted = rows.join(plan_df, "cell").withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.col("salts")).cast("int"))
    in_cell = Window.partitionBy("cell").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        salted.groupBy("cell", "salt").agg(F.count("*").alias("n"))
        .select("cell", "salt", F.coalesce(F.sum("n").over(in_cell), F.lit(0)).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size"))
    return (
        salted.withColumn("rank", rank)
        .join(starts, ["cell", "salt"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("cell_base") + F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
