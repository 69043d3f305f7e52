"""Optimal one-to-one assignment over gated pairs.

Components of the gated pairs are independent. Small ones are dealt to tasks, many at a time, and solved by shortest
augmenting paths over their own pairs. A larger one is an auction in rounds over a written table of prices: its left sides
are cut into ranges of nearby places, and every range with a left side that has no partner bids. Within a range the bids are
worked out at once, by augmenting paths; a partner that is held elsewhere costs its price and ``eps``. What a range has won it
then values as high as its own alternatives allow, and that is its bid. The highest bid for a partner stands; a left side that
loses its partner is without one again. Every other round cuts in the middle of the ranges of the round before, and as rounds
go by ranges are joined, up to a bound, so that what competes comes into one task.

Prices only rise, a partner without a holder is at price zero, and a left side that stays alone finds no partner worth its
price, so the total is at most ``eps`` per side short of the best: with whole scores and ``eps`` below one by the number of
sides, it is the best.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.operators.graph import connected_components, node_ranks
from orbitrace.session import discard, materialize

#: Pairs that a task solves at a time, if they are of small components, and of a range at first.
LOCAL_PAIRS = 200_000
#: Pairs that a component may have to be solved in one task, which holds some 160 bytes for each.
WHOLE_PAIRS = 3_000_000
#: Scores are whole multiples of the largest one over this.
STEPS = 1 << 30
#: Pairs of a range at most, on average, however many rounds there are.
RANGE_PAIRS = 2_000_000


def settle(rows: list[list[tuple[int, int, int]]], ask: list[int], owner: list[int], holds: list[int], pair: list[int], todo: list[int]) -> list[int]:
    """Gives the left sides ``todo`` the partners that make the total worth the most, by shortest augmenting paths; returns those
    that stay alone.

    ``rows`` has (right side, gain, number of the pair) of each left side, ``ask`` what a right side costs, ``owner`` the left
    side of here that holds it (-1: none of here), ``holds`` the reverse and ``pair`` the number of the pair by which it is
    held; the last four are changed in place. A path only goes as far as the competition for its side does.
    """
    profit = [0] * len(rows)
    for i, c in enumerate(holds):
        if c >= 0:
            profit[i] = next(w for x, w, _ in rows[i] if x == c) - ask[c]
    alone = []
    for start in todo:
        profit[start] = max(0, *(w - ask[c] for c, w, _ in rows[start]))
        settled: dict[int, int] = {}
        came: dict[int, tuple[int, int, int]] = {}
        heap: list[tuple[int, int, int]] = [(profit[start], -1, start)]  # the way that ends in a left side alone
        i, far = start, 0
        while True:
            for c, w, e in rows[i]:
                if c not in settled:
                    d = far + max(0, profit[i] - w + ask[c])
                    if c not in came or d < came[c][0]:
                        came[c] = (d, i, e)
                        heappush(heap, (d, c, i))
            while True:
                far, c, i = heappop(heap)
                if c < 0 or (c not in settled and came[c][0] == far):
                    break
            if c < 0 or owner[c] < 0:
                break
            settled[c] = far
            i = owner[c]
            heappush(heap, (far + profit[i], -1, i))
        for x, d in settled.items():
            ask[x] += far - d
            profit[owner[x]] -= far - d
        profit[start] -= far
        # along the path every left side takes the right side that it led to
        end = c
        if c < 0:
            alone.append(i)
            if i != start:
                end, holds[i] = holds[i], -1
        while end >= 0:
            _, left, e = came[end]
            before, holds[left] = holds[left], end
            owner[end], pair[end] = left, e
            end = before
    return alone


def raise_prices(rows: list[list[tuple[int, int, int]]], ask: list[int], owner: list[int], holds: list[int]) -> None:
    """Raises the prices of what is held here until every holder is as well off with another partner or alone."""
    wanted: list[list[tuple[int, int]]] = [[] for _ in ask]
    gain = [0] * len(rows)
    for i, c in enumerate(holds):
        if c >= 0:
            for x, w, _ in rows[i]:
                wanted[x].append((i, w))
                if x == c:
                    gain[i] = w
    slack = [0] * len(rows)
    heap = []
    for i, c in enumerate(holds):
        if c >= 0:
            own = gain[i] - ask[c]
            slack[i] = max(0, min([own, *(own - w + ask[x] for x, w, _ in rows[i] if owner[x] < 0)]))
            heap.append((slack[i], i))
    heap.sort()
    done = [False] * len(rows)
    while heap:
        d, i = heappop(heap)
        if done[i] or d > slack[i]:
            continue
        done[i] = True
        c = holds[i]
        for j, w in wanted[c]:
            if not done[j]:
                other = d + max(0, gain[j] - ask[holds[j]] - w + ask[c])
                if other < slack[j]:
                    slack[j] = other
                    heappush(heap, (other, j))
    for i, c in enumerate(holds):
        if c >= 0:
            ask[c] += slack[i]


def assign(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> list[int]:
    """Numbers of the pairs ``(a[i], b[i])`` of the best assignment; gains are whole and positive, pairs distinct."""
    _, a = np.unique(a, return_inverse=True)
    _, b = np.unique(b, return_inverse=True)
    rows = _adjacent(a, b, gain)
    many = int(b.max()) + 1
    pair = [-1] * many
    settle(rows, [0] * many, [-1] * many, [-1] * len(rows), pair, list(range(len(rows))))
    return [e for e in pair if e >= 0]


def _adjacent(a: np.ndarray, b: np.ndarray, gain: np.ndarray) -> list[list[tuple[int, int, int]]]:
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(int(a.max()) + 1)]
    for e, (i, c, w) in enumerate(zip(a.tolist(), b.tolist(), gain.tolist(), strict=True)):
        rows[i].append((c, w, e))
    return rows


def _solved(left: str, right: str, names: list[str]):
    """Whole components, many at a time; the batches are in the order of ``__block``."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        picked = assign(node_ranks(rows.column(left)), node_ranks(rows.column(right)), np.asarray(rows.column("__gain")))
        return rows.select(names).take(pa.array(picked, pa.int64()))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                room = min(batch.num_rows, max(1, LOCAL_PAIRS - n))
                block = node_ranks(batch.column("__block"))
                cut = room
                if n + room >= LOCAL_PAIRS:  # not before the block ends
                    while cut < batch.num_rows and block[cut] == block[cut - 1]:
                        cut += 1
                held.append(batch.slice(0, cut))
                n += cut
                batch = batch.slice(cut)
                if batch.num_rows and n >= LOCAL_PAIRS:
                    yield solve(held)
                    held, n = [], 0
        if n:
            yield solve(held)

    return run


def optimal_assignment(scores: DataFrame, left: str, right: str, score: str, place: str | None = None, local_pairs: int | None = None, group: str | None = None) -> DataFrame:
    """One-to-one pairs ``left, right, score`` of the highest total score; the scores count as multiples of the largest one over 2^30.

    Pairs with a null end or a score that is null, NaN or not positive never help and go; of equal pairs the best one counts.
    Ties between assignments of one total are open. Components of more than ``local_pairs`` pairs (``WHOLE_PAIRS``) go through
    rounds over a table of prices, which take many times as long as paths in one task; ``place``, a number in which near left sides are alike, then keeps those that compete in one task.
    ``group``, a column that all pairs of a side share (a frame), saves the rounds that look for components across the table; a
    group of over ``LOCAL_PAIRS`` and up to ``WHOLE_PAIRS`` pairs, which is mostly one component, is solved as it is.
    """
    whole, local_pairs = (WHOLE_PAIRS, LOCAL_PAIRS) if local_pairs is None else (local_pairs, local_pairs)
    keep = scores.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(score) > 0) & ~F.isnan(score))
    keep = keep.groupBy(left, right).agg(F.max(score).alias(score), *([F.first(place).cast("double").alias("__place")] if place else []), *([F.first(group).alias("__group")] if group else []))
    keep = materialize(keep, "pairs")
    top = keep.agg(F.max(score).alias("m")).first().m
    if top is None:
        return keep.select(left, right, score)
    keep = keep.withColumn("__gain", F.greatest(F.lit(1), F.round(F.col(score) * (STEPS / float(top)))).cast("long"))
    tasks = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [left, right, score]
    schema = keep.select(*names).schema

    def solved(blocked: DataFrame) -> DataFrame:
        return blocked.repartition(tasks, "__block").sortWithinPartitions("__block").mapInArrow(_solved(left, right, names), schema)

    done = None
    if group:
        # a large group that one task can solve needs no components; there is at most one for every `local_pairs` pairs
        sizes = keep.groupBy(F.col("__group").alias("__g")).agg(F.count("*").alias("n"))
        at_once = materialize(sizes.where((F.col("n") > local_pairs) & (F.col("n") <= whole)).select("__g"), "groups")
        if at_once.limit(1).count():
            same = F.col("__group").eqNullSafe(F.col("__g"))
            done = solved(keep.join(F.broadcast(at_once), same, "left_semi").withColumn("__block", F.col("__group")))
            keep = keep.join(F.broadcast(at_once), same, "left_anti")
            if not keep.limit(1).count():
                return done
    side = lambda c, tag: F.struct(*([F.col("__group").alias("group")] if group else []), F.lit(tag).alias("side"), F.col(c).cast("string").alias("id"))
    parts = connected_components(keep.select(side(left, "l").alias("src"), side(right, "r").alias("dst")), block="u.group" if group else None)
    blocked = keep.withColumn("node", side(left, "l")).join(parts, "node").withColumnRenamed("component", "__block").drop("node")
    blocked = materialize(blocked, "pairs")
    sizes = blocked.groupBy("__block").agg(F.count("*").alias("n")).where(F.col("n") > whole)
    crowded = materialize(sizes.select("__block"), "crowded")
    large = crowded.limit(1).count() > 0
    small = blocked.join(crowded, "__block", "left_anti") if large else blocked
    out = solved(small) if done is None else done.unionByName(solved(small))
    return out.unionByName(_by_rounds(blocked.join(crowded, "__block", "left_semi"), left, right, score, place is not None, local_pairs)) if large else out


def _by_rounds(pairs: DataFrame, left: str, right: str, score: str, placed: bool, local_pairs: int) -> DataFrame:
    """The same by rounds over a table of prices, one auction for all pairs given."""
    from orbitrace.operators.stats import numbered

    ids = [materialize(numbered(pairs.select(c).distinct(), c, k), "ids") for c, k in ((left, "__a"), (right, "__b"))]
    rows = pairs.join(ids[0], left).join(ids[1], right).withColumn("__zone", F.col("__place") if placed else F.col("__a").cast("double"))
    rows = materialize(rows.select(left, right, score, "__a", "__b", "__gain", "__zone"), "rounds")
    sides, total = rows.agg(F.max("__a") + F.max("__b") + 2, F.count("*")).first()
    first = materialize(rows.groupBy("__a").agg(F.min("__zone").alias("zone")), "zones")
    # eps is 1
    edges = materialize(rows.join(first, "__a").select(F.col("__a").alias("who"), F.col("__b").alias("obj"), (F.col("__gain") * (sides + 1)).alias("gain"), "zone"), "edges")
    todo = first.select(F.col("__a").alias("who"), "zone")
    price = edges.select("obj").distinct().select("obj", F.lit(0).cast("long").alias("price"), F.lit(None).cast("long").alias("owner"))
    ranges, turn = max(1, -(-total // local_pairs)), 0
    least = max(1, -(-total // RANGE_PAIRS))
    while True:
        if turn and turn % 4 == 0:
            ranges = max(least, ranges // 2)
        # as many ranges as bound a task's pairs; every other round cuts in the middle of those of the round before
        shares = [(i + 0.5 * (turn % 2)) / ranges for i in range(ranges)]
        cuts = edges.select(F.percentile_approx("zone", [x for x in shares if x > 0] or [1.0], F.lit(100_000)).alias("c")).first().c
        cut = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col("zone")))
        idle = todo.join(price.where("owner IS NOT NULL").select(F.col("owner").alias("who")), "who", "left_anti")
        # at most one number a range
        open_ = [r.r for r in idle.select(cut.alias("r")).distinct().collect()]
        if not open_:
            break
        work = edges.withColumn("range", cut).where(F.col("range").isin(open_)).join(price, "obj")
        dealt = work.repartition(len(open_), "range").sortWithinPartitions("range", "who")
        bids = materialize(dealt.mapInArrow(_bids, "obj long, price long, owner long"), "bids")
        every = price.unionByName(bids.where("obj IS NOT NULL"))
        best = F.struct("price", "owner")
        nxt = materialize(every.groupBy("obj").agg(F.max_by(best, best).alias("x")).select("obj", "x.*"), "price")
        rest = materialize(todo.join(bids.where("obj IS NULL").select(F.col("owner").alias("who")), "who", "left_anti"), "todo")
        for old in (price, todo, bids):
            if hasattr(old, "_path"):
                discard(old)
        price, todo, turn = nxt, rest, turn + 1
    got = price.where("owner IS NOT NULL").select(F.col("owner").alias("__a"), F.col("obj").alias("__b"))
    return rows.join(got, ["__a", "__b"]).select(left, right, score)


def _bids(batches):
    """A range's bids for right sides; a left side that stays alone is a row without one. Ranges follow one after the other."""

    def place(parts: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(parts)
        who, obj, gain, price = (np.asarray(whole.column(c)) for c in ("who", "obj", "gain", "price"))
        holder = whole.column("owner").to_pandas().fillna(-1).to_numpy(np.int64)
        bidders, a = np.unique(who, return_inverse=True)
        objects, first, b = np.unique(obj, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(bidders, holder[first]), len(bidders) - 1)
        here = (holder[first] >= 0) & (bidders[at] == holder[first])
        owner = np.where(here, at, -1)
        before = price[first] + ((holder[first] >= 0) & ~here)  # what is held elsewhere costs more
        rows, ask, own = _adjacent(a, b, gain), before.tolist(), owner.tolist()
        holds = [-1] * len(rows)
        for c in np.flatnonzero(here).tolist():
            holds[own[c]] = c
        todo = [i for i, c in enumerate(holds) if c < 0]
        alone = settle(rows, ask, own, holds, [-1] * len(ask), todo)
        raise_prices(rows, ask, own, holds)
        new = [c for c in range(len(ask)) if own[c] >= 0 and (own[c] != owner[c] or ask[c] != before[c])]
        return pa.RecordBatch.from_arrays(
            [pa.array(objects[np.array(new, int)].tolist() + [None] * len(alone), pa.int64()), pa.array([ask[c] for c in new] + [None] * len(alone), pa.int64()),
             pa.array(bidders[np.array([own[c] for c in new], int)].tolist() + bidders[np.array(alone, int)].tolist(), pa.int64())],
            names=["obj", "price", "owner"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        part = np.asarray(batch.column("range"))
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                if held and held[0].column("range")[0].as_py() != part[a]:
                    yield place(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield place(held)
