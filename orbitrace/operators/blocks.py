"""Near rows of a frame, met in blocks of space: Spark deals rows to blocks, numpy compares those of a block on a grid.

A block is a cube with an edge of some radii. A row is owned by one block and is copied to those that its radius reaches into,
about three on a surface. What leaves a task is a row per owned row (sums, nearest rows, links to a smallest row), or the pairs
in batches where pairs are the result. Comparing follows the number of near pairs, memory the rows of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitrace.operators.graph import node_ranks

AXES = ("x", "y", "z")
#: Distances that are held at a time.
PIECE = 131_072
#: Candidates a row on average up to which pairs are listed, not set out in a matrix for each cell.
LISTED = 512


def near_blocks(left: DataFrame, right: DataFrame, radius, frame: str, axes, work: Callable, schema: str, span: int = 4) -> DataFrame:
    """``work(left, right, radius)`` for every block: Arrow tables of the rows it owns of ``left`` and of the ``right`` rows
    within ``radius`` of any place in it; ``work`` yields record batches of ``schema``.

    ``radius`` is a number, or a column that is the same for all rows of a frame. Rows without a frame, or with a null or
    infinite coordinate, are in no block.
    """
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    told = F.col(frame).isNotNull() & (F.col("__r") > 0)
    for a in axes:
        told = told & F.col(a).isNotNull() & (F.abs(a) < float("inf"))
    edge, reach = F.col("__r") * span, F.col("__r") * (1 + 1e-9)
    keys = ["__f", *(f"__b{i}" for i in range(len(axes)))]

    def dealt(df, copies):
        own = [F.floor(F.col(a) / edge).cast("bigint") for a in axes]
        out = df.withColumn("__r", r).where(told).withColumn("__own", F.struct(*own))
        row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        out = out.select(F.col(frame).alias("__f"), "__own", "__r", *(F.col(a).alias(f"__p{i}") for i, a in enumerate(axes)), row.alias("row"))
        for i in range(len(axes)):
            p, slack = F.col(f"__p{i}"), reach + F.abs(f"__p{i}") * 1e-12
            blocks = F.sequence(F.floor((p - slack) / edge).cast("bigint"), F.floor((p + slack) / edge).cast("bigint")) if copies else None
            out = out.withColumn(f"__b{i}", F.explode(blocks) if copies else F.floor(p / edge).cast("bigint"))
        return out.withColumn("own", F.col("__own") == F.struct(*(F.col(f"__b{i}") for i in range(len(axes))))).drop("__own", *(f"__p{i}" for i in range(len(axes))))

    same = left is right
    if same:
        rows = dealt(right, True)
    else:
        rows = dealt(left, False).select(*keys, "__r", F.col("row").alias("l"), F.lit(None).alias("r"))
        rows = rows.unionByName(dealt(right, True).select(*keys, "__r", F.lit(None).alias("l"), F.col("row").alias("r")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()
        mine, near = (whole.column("row").filter(whole.column("own")), whole.column("row")) if same else (whole.column(c).filter(whole.column(c).is_valid()) for c in "lr")
        if len(mine) and len(near):
            yield from work(*(pa.Table.from_struct_array(x).combine_chunks() for x in (mine, near)), whole.column("__r")[0].as_py())

    # a block is much work for few bytes, so small partitions are not put together
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).groupBy(*keys).applyInArrow(run, schema)


def points(table: pa.Table, axes) -> np.ndarray:
    return np.column_stack([table.column(a).to_numpy() for a in axes]).astype(float)


def _sorted_cells(at: np.ndarray, low: np.ndarray, edge: float, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points by cell, and their cell numbers in that order; a margin of 2 cells is left around."""
    code = np.zeros(len(at), np.int64)
    for k in range(at.shape[1]):
        code = code * sides[k] + np.floor((at[:, k] - low[k]) / edge).astype(np.int64) + 2
    order = np.argsort(code, kind="stable")
    return order, code[order]


def visit(a: np.ndarray, b: np.ndarray, radius: float, ordered: bool = False):
    """Yields ``rows, others, distances, within``: row numbers of ``a`` and ``b``, the matrix of their distances and whether
    they are at most ``radius``. Every pair within it is in one matrix. ``ordered``: the others are in ascending order, and all
    others of a row are in one matrix, always."""
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    edge, wide = radius * (1 + 1e-9), 1
    used = lambda e: len(np.unique(np.floor((a - low) / e).astype(np.int64), axis=0))
    crowd = len(a) / used(edge)
    if crowd < 4:
        edge *= 2  # few rows a cell: fewer and larger cells
    elif crowd > 64:
        edge, wide = edge / 2, 2
    sides = np.floor((high - low) / edge).astype(np.int64) + 5
    mine, mine_code = _sorted_cells(a, low, edge, sides)
    other, other_code = _sorted_cells(b, low, edge, sides)
    cells, first = np.unique(mine_code, return_index=True)
    last = np.append(first[1:], len(mine))
    steps = np.zeros(1, np.int64)
    for k, side in enumerate(sides):
        if k < len(sides) - 1:
            steps = (steps[:, None] + np.arange(-wide, wide + 1)[None, :]).ravel() * sides[k + 1]
    begin = np.searchsorted(other_code, cells[:, None] + steps - wide, "left")
    end = np.searchsorted(other_code, cells[:, None] + steps + wide, "right")
    for i in range(len(cells)):
        parts = [other[s:e] for s, e in zip(begin[i].tolist(), end[i].tolist(), strict=True) if e > s]
        if not parts:
            continue
        near = np.concatenate(parts)
        if ordered:
            near.sort()
        place, step = b[near].T.copy(), max(1, PIECE // len(near))
        for at in range(first[i], last[i], step):
            rows = mine[at : min(at + step, last[i])]
            d = a[rows, :1] - place[0]
            d *= d
            for k in range(1, len(place)):
                e = a[rows, k : k + 1] - place[k]
                e *= e
                d += e
            np.sqrt(d, out=d)
            yield rows, near, d, d <= radius


def listed(a: np.ndarray, b: np.ndarray, radius: float):
    """Yields ``rows, i, j, distances`` of the pairs within ``radius``: ``rows`` are some row numbers of ``a``, pair by pair ``i`` is
    a place in ``rows``, ascending, and ``j`` a row number of ``b``; all pairs of a row come at once. For rows with few candidates:
    None where there are over ``LISTED`` a row."""
    low, high = np.minimum(a.min(0), b.min(0)), np.maximum(a.max(0), b.max(0))
    edge = radius * (1 + 1e-9)
    sides = np.floor((high - low) / edge).astype(np.int64) + 5
    mine, mine_code = _sorted_cells(a, low, edge, sides)
    other, other_code = _sorted_cells(b, low, edge, sides)
    steps = np.zeros(1, np.int64)
    for side in sides[1:]:
        steps = (steps[:, None] + np.arange(-1, 2)[None, :]).ravel() * side
    cells, cell = np.unique(mine_code, return_inverse=True)
    begin = np.searchsorted(other_code, cells[:, None] + steps - 1, "left")
    many = np.searchsorted(other_code, cells[:, None] + steps + 1, "right") - begin
    reach = np.append(0, np.cumsum(many.sum(axis=1)[cell]))
    if reach[-1] > LISTED * len(a):
        return None

    def pairs():
        at = 0
        while at < len(mine):
            end = max(at + 1, int(np.searchsorted(reach, reach[at] + 4 * PIECE, "right")) - 1)
            here, n = cell[at:end], many[cell[at:end]].ravel()
            first = np.append(0, np.cumsum(n)[:-1])
            j = other[np.repeat(begin[here].ravel() - first, n) + np.arange(n.sum())]
            i = np.repeat(np.arange(end - at), many[here].sum(axis=1))
            rows, d = mine[at:end], 0.0
            for k in range(a.shape[1]):
                e = a[rows, k][i] - b[j, k]
                d = d + e * e
            d = np.sqrt(d)
            near = d <= radius
            yield rows, i[near], j[near], d[near]
            at = end

    return pairs()


def coded(left: pa.Table, right: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the keys of both tables, equal for equal keys."""
    codes = ranks([*left.column(key).chunks, *right.column(key).chunks])
    return codes[: left.num_rows], codes[left.num_rows :]


def ranks(chunks: list[pa.Array]) -> np.ndarray:
    return node_ranks(pa.concat_arrays(chunks))


def by_key(table: pa.Table, key: str) -> pa.Table:
    return table.take(pa.array(np.argsort(ranks(table.column(key).chunks), kind="stable"))).combine_chunks()


def near_sums(left: DataFrame, right: DataFrame, radius, frame: str = "t", key: str = "track_id", axes=AXES, values=(), include_self: bool = True, measure=None, enough: int | None = None) -> DataFrame:
    """``frame, key, n`` and sums over the ``right`` rows within ``radius`` of a ``left`` row; rows near to none have no row.

    ``s_<v>`` is the sum of a double column of ``right`` (null and NaN left out) and ``n_<v>`` the number summed;
    ``measure`` maps distances to values, whose sum is ``s_distance``. With ``enough``, ``n`` is exact below it and need not
    grow above it: rows of a cell that is smaller than the radius and holds so many are not compared.
    """
    kinds = dict(left.dtypes)
    names = [frame, key, "n", *(f"{p}_{v}" for v in values for p in "sn"), *(["s_distance"] if measure else [])]
    schema = ", ".join([f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, n bigint", *(f"`s_{v}` double, `n_{v}` double" for v in values), *(["s_distance double"] if measure else [])])

    def work(mine, near, r):
        own, other = coded(mine, near, key)
        n, away = np.zeros(mine.num_rows, np.int64), np.zeros(mine.num_rows)
        given = [near.column(v).to_numpy().astype(float) for v in values]
        table = np.column_stack([x for v in given for x in (np.nan_to_num(v, nan=0.0, posinf=np.inf, neginf=-np.inf), ~np.isnan(v))]).astype(float) if values else None
        sums = np.zeros((mine.num_rows, 2 * len(values)))
        a, b, todo = points(mine, axes), points(near, axes), np.arange(mine.num_rows)
        if enough is not None and include_self and not values and not measure:
            edge, low = r / np.sqrt(len(axes)) * (1 - 1e-6), np.minimum(a.min(0), b.min(0))
            _, cell, size = np.unique(np.floor((np.concatenate([a, b]) - low) / edge), axis=0, return_inverse=True, return_counts=True)
            n[:] = np.bincount(cell.ravel()[len(a) :], minlength=len(size))[cell.ravel()[: len(a)]]
            todo = np.flatnonzero(n < enough)
            n[todo] = 0
        for rows, others, d, within in visit(a[todo], b, r) if len(todo) else ():
            rows = todo[rows]
            if not include_self:
                within &= own[rows, None] != other[others]
            count = np.count_nonzero(within, axis=1)
            n[rows] += count
            if values:
                sums[rows] += within.astype(float) @ table[others]
            if measure:
                some = count > 0
                if some.any():
                    at = np.append(0, np.cumsum(count[some])[:-1])
                    away[rows[some]] += np.add.reduceat(measure(d[within]), at)
        some = n > 0
        got = [mine.column(frame), mine.column(key), pa.array(n), *(pa.array(sums[:, i]) for i in range(2 * len(values))), *([pa.array(away)] if measure else [])]
        yield from pa.table(got, names=names).filter(pa.array(some)).to_batches()

    cols = list(dict.fromkeys([frame, key, *axes]))
    slim = right.select(*dict.fromkeys([*cols, *values]))
    return near_blocks(slim if left is right else left.select(*cols), slim, radius, frame, axes, work, schema)


def near_first(left: DataFrame, right: DataFrame, k: int, radius, frame: str = "t", key: str = "track_id", axes=AXES, include_self: bool = True, want: str | None = None, span: int = 4, carry=(), fold=None) -> DataFrame:
    """``frame, key, n_key, distance, rank``: the ``k`` nearest ``right`` rows within ``radius`` of each ``left`` row, ties by the
    smaller ``n_key``. With ``want``, a column of ``left``, only for rows that have so many within the radius, themselves counted.

    ``fold`` is the names of double columns and a function that makes them, one row for a left row, in place of the rows that
    are near: for the tables of a block, with the columns ``carry`` too, it gives a function of left row numbers and a matrix of
    those of their nearest rows, -1 where there are fewer than ``k``. NaN becomes null. Left rows that got none, of blocks with
    right rows, are there too, with their columns as a struct ``__open``, which is null for the others.
    """
    kinds = dict(left.dtypes)
    names = [frame, key, *([*fold[0], "__open"] if fold else [f"n_{key}", "distance", "rank"])]
    row = [*axes, *carry]
    rest = ", ".join([*(f"`{c}` double" for c in fold[0]), f"__open struct<{', '.join(f'`{c}`: {kinds[c]}' for c in row)}>"]) if fold else f"`n_{key}` {dict(right.dtypes)[key]}, distance double, rank int"
    schema = f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, {rest}"

    def picks(mine, near, r, wanted):
        """Yields row numbers of ``mine``, and for each of them those of the ``k`` nearest rows (-1: no more) and their distances."""
        own, other = (None, None) if include_self else coded(mine, near, key)
        a, b = points(mine, axes), points(near, axes)
        pairs = listed(a, b, r)
        for rows, i, j, d in pairs or ():
            keep = np.ones(len(i), bool) if include_self else own[rows[i]] != other[j]
            if wanted is not None:
                keep &= (np.bincount(i, minlength=len(rows)) >= wanted[rows])[i]
            i, j, d = i[keep], j[keep], d[keep]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(rows)))[i]
            i, j, d, rank = (x[rank < k] for x in (i, j, d, rank))
            picked, far = np.full((len(rows), k), -1), np.full((len(rows), k), np.inf)
            picked[i, rank], far[i, rank] = j, d
            yield rows, picked, far
        for rows, others, d, within in visit(a, b, r, ordered=True) if pairs is None else ():
            d[~within] = np.inf
            good = np.ones(len(rows), bool) if wanted is None else np.count_nonzero(within, axis=1) >= wanted[rows]
            if not include_self:
                d[own[rows, None] == other[others]] = np.inf
            rows, d, line = rows[good], d[good], np.arange(int(good.sum()))
            picked, far = np.full((len(rows), k), -1), np.full((len(rows), k), np.inf)
            for rank in range(k if len(rows) else 0):
                best = d.argmin(axis=1)
                far[:, rank] = d[line, best]
                d[line, best] = np.inf
                told = far[:, rank] < np.inf
                if not told.any():
                    break
                picked[told, rank] = others[best[told]]
            yield rows, picked, far

    def work(mine, near, r):
        near = by_key(near, key)
        wanted = mine.column(want).to_numpy() if want else None
        folded = fold[1](mine, near) if fold else None
        held, n, open_ = [], 0, np.ones(mine.num_rows, bool)
        for part in picks(mine, near, r, wanted):
            held.append(part)
            n += len(part[0])
            if n * k >= PIECE:
                yield from told(mine, near, held, folded, open_)
                held, n = [], 0
        if n:
            yield from told(mine, near, held, folded, open_)
        if fold and open_.any():
            take = pa.array(np.flatnonzero(open_))
            none, again = pa.nulls(len(take), pa.float64()), pa.StructArray.from_arrays([mine.column(c).take(take).combine_chunks() for c in row], row)
            yield from pa.table([mine.column(frame).take(take), mine.column(key).take(take), *(none for _ in fold[0]), again], names=names).combine_chunks().to_batches()

    def told(mine, near, held, folded, open_):
        rows, picked, far = (np.concatenate(x) for x in zip(*held, strict=True))
        if fold:
            some = picked[:, 0] >= 0
            rows, picked = rows[some], picked[some]
            open_[rows] = False
            take = pa.array(rows)
            made = [pa.array(np.asarray(c, float), from_pandas=True) for c in folded(rows, picked)] if len(rows) else [pa.nulls(0, pa.float64()) for _ in fold[0]]
            made.append(pa.nulls(len(rows), pa.struct([(c, mine.schema.field(c).type) for c in row])))
        else:
            i, rank = np.nonzero(picked >= 0)
            take = pa.array(rows[i])
            made = [near.column(key).take(pa.array(picked[i, rank])), pa.array(far[i, rank]), pa.array((rank + 1).astype(np.int32))]
        return pa.table([mine.column(frame).take(take), mine.column(key).take(take), *made], names=names).combine_chunks().to_batches()

    cols = list(dict.fromkeys([frame, key, *axes]))
    cols += carry
    reach = ["__reach"] if isinstance(radius, Column) else []
    slim = left.select(*cols, *reach, *([want] if want else []))
    return near_blocks(slim, slim if left is right else right.select(*cols, *reach), radius, frame, axes, work, schema, span)


def near_rows(left: DataFrame, right: DataFrame, radius, frame: str = "t", key: str = "track_id", axes=AXES, include_self: bool = True, span: int = 4) -> DataFrame:
    """``frame, key, n_key, distance`` of all pairs within ``radius``; their number is that of the result, so a task yields them
    in batches."""
    kinds = dict(left.dtypes)
    names = [frame, key, f"n_{key}", "distance"]
    schema = f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, `n_{key}` {dict(right.dtypes)[key]}, distance double"

    def work(mine, near, r):
        own, other = (None, None) if include_self else coded(mine, near, key)
        held, n = [], 0
        for rows, others, d, within in visit(points(mine, axes), points(near, axes), r):
            if not include_self:
                within &= own[rows, None] != other[others]
            i, j = np.nonzero(within)
            held.append((rows[i], others[j], d[within]))
            n += len(i)
            if n >= PIECE:
                yield from pairs(mine, near, held)
                held, n = [], 0
        if n:
            yield from pairs(mine, near, held)

    def pairs(mine, near, held):
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        take = pa.array(i)
        cols = [mine.column(frame).take(take), mine.column(key).take(take), near.column(key).take(pa.array(j)), pa.array(d)]
        return pa.table(cols, names=names).combine_chunks().to_batches()

    cols = list(dict.fromkeys([frame, key, *axes]))
    slim = right.select(*cols)
    return near_blocks(slim if left is right else left.select(*cols), slim, radius, frame, axes, work, schema, span)


def first_of(a: np.ndarray, b: np.ndarray, radius: float) -> np.ndarray:
    """Row number of the nearest row of ``b`` within ``radius`` for each row of ``a``, the smaller one of equals, -1 for none."""
    out = np.full(len(a), -1)
    if len(a) and len(b):
        pairs = listed(a, b, radius)
        for rows, i, j, d in pairs or ():
            order = np.lexsort((j, d, i))
            who, at = np.unique(i[order], return_index=True)
            out[rows[who]] = j[order][at]
        for rows, others, d, within in visit(a, b, radius, ordered=True) if pairs is None else ():
            d[~within] = np.inf
            best = d.argmin(axis=1)
            told = d[np.arange(len(rows)), best] < np.inf
            out[rows[told]] = others[best[told]]
    return out


def sure_pairs(a: np.ndarray, b: np.ndarray, radius: float, a_whole: np.ndarray, b_whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers ``i, j`` of the pairs that taking all pairs within ``radius`` nearest first, ties by the smaller rows, one to one, must
    take, and which rows of ``a`` and ``b`` are still open.

    ``*_whole`` says that all rows near to a row are here. A pair that is the nearest of all open ones for both of its rows is
    taken if both are whole; a row that may be taken by one that is not here counts as open, so what is found is sure.
    """
    open_a, open_b, pairs = np.ones(len(a), bool), np.ones(len(b), bool), []
    first_a, first_b = first_of(a, b, radius), first_of(b, a, radius)
    while True:
        i = np.flatnonzero(open_a & a_whole & (first_a >= 0))
        j = first_a[i]
        sure = open_b[j] & b_whole[j] & (first_b[j] == i)
        i, j = i[sure], j[sure]
        if not len(i):
            break
        pairs.append((i, j))
        open_a[i], open_b[j] = False, False
        for first, own, other, p, q in ((first_a, open_a, open_b, a, b), (first_b, open_b, open_a, b, a)):
            todo, free = np.flatnonzero(own & (first >= 0) & ~other[first]), np.flatnonzero(other)
            found = first_of(p[todo], q[free], radius)
            first[todo] = np.where(found >= 0, free[found], -1) if len(free) else -1
    open_a &= (first_a >= 0) | ~a_whole
    open_b &= (first_b >= 0) | ~b_whole
    i, j = (np.concatenate([x[k] for x in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    return i, j, open_a, open_b


def near_sure(left: DataFrame, right: DataFrame, radius: float, frame: str, key: str, halo: int, axes=AXES) -> DataFrame:
    """``frame, key, n_key, distance`` of ``sure_pairs`` of the rows in a block and those up to ``halo`` radii around it, where a pair can
    be found twice, and the rows that are open in the block that owns them: with ``side`` 0 for left and 1 for right and ``at``."""
    kinds = dict(left.dtypes)
    schema = f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, `n_{key}` {kinds[key]}, distance double, side int, at array<double>"
    span, names = 4, [frame, key, f"n_{key}", "distance", "side", "at"]

    def work(mine, near, r):
        near = by_key(near, key)
        at, side = points(near, axes), near.column("__side").to_numpy()
        edge = r * span
        block = np.floor(points(mine, axes)[0] / edge)
        own = (np.floor(at / edge) == block).all(axis=1)
        slack = r - radius * (1 + 1e-6)
        whole = ((at >= block * edge - slack) & (at <= (block + 1) * edge + slack)).all(axis=1)
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j, open_a, open_b = sure_pairs(at[one], at[two], radius, whole[one], whole[two])
        i, j = one[i], two[j]
        here = own[i] | own[j]
        i, j = i[here], j[here]
        rest = np.concatenate([one[open_a], two[open_b]])
        rest = rest[own[rest]]
        take, d = pa.array(np.concatenate([i, rest])), np.zeros(len(i))
        for k in range(len(axes)):
            e = at[i, k] - at[j, k]
            d += e * e
        none = len(rest)
        others = pa.chunked_array([*near.column(key).take(pa.array(j)).chunks, pa.nulls(none, near.schema.field(key).type)])
        places = pa.array([None] * len(i) + at[rest].tolist(), pa.list_(pa.float64()))
        cols = [near.column(frame).take(take), near.column(key).take(take), others, pa.array(np.append(np.sqrt(d), np.zeros(none))), pa.array([None] * len(i) + side[rest].tolist(), pa.int32()), places]
        yield from pa.table(cols, names=names).combine_chunks().to_batches()

    cols = list(dict.fromkeys([frame, key, *axes]))
    both = left.select(*cols, F.lit(0).alias("__side")).unionByName(right.select(*cols, F.lit(1).alias("__side")))
    return near_blocks(both, both, radius * halo, frame, axes, work, schema, span)


def near_groups(left: DataFrame, right: DataFrame, radius, frame: str, group: str, axes=AXES) -> DataFrame:
    """``frame, group, n_group, left, right``: how many rows of a left group lie within ``radius`` of some row of a right one, and
    the reverse. A row is counted in the block that owns it, so the sums over blocks are exact; groups without near rows have no row.
    """
    kinds, other = dict(left.dtypes), dict(right.dtypes)
    names = [frame, group, f"n_{group}", "left", "right"]
    schema = f"`{frame}` {kinds[frame]}, `{group}` {kinds[group]}, `n_{group}` {other[group]}, left bigint, right bigint"

    def counted(flip):
        def work(mine, near, r):
            a, b = ranks(mine.column(group).chunks), ranks(near.column(group).chunks)
            _, first_a, a = np.unique(a, return_index=True, return_inverse=True)
            _, first_b, b = np.unique(b, return_index=True, return_inverse=True)
            held = np.zeros((len(first_a), len(first_b)), np.int64)
            for rows, others, _, within in visit(points(mine, axes), points(near, axes), r):
                some, code = np.unique(b[others], return_inverse=True)
                order = np.argsort(code, kind="stable")
                start = np.searchsorted(code[order], np.arange(len(some)))
                any_ = np.logical_or.reduceat(within[:, order], start, axis=1)
                # all others of a row are in one matrix
                i, j = np.nonzero(any_)
                np.add.at(held, (a[rows[i]], some[j]), 1)
            i, j = np.nonzero(held)
            n, none = pa.array(held[i, j]), pa.array(np.zeros(len(i), np.int64))
            ends = mine.column(group).take(pa.array(first_a[i])), near.column(group).take(pa.array(first_b[j]))
            at = mine.column(frame).take(pa.array(first_a[i]))
            cols = [at, *ends[::-1], none, n] if flip else [at, *ends, n, none]
            yield from pa.table(cols, names=names).combine_chunks().to_batches()

        return work

    cols = list(dict.fromkeys([frame, group, *axes]))
    a, b = left.select(*cols), right.select(*cols)
    return near_blocks(a, b, radius, frame, axes, counted(False), schema).unionByName(near_blocks(b, a, radius, frame, axes, counted(True), schema))


def joined_cells(at: np.ndarray, radius: float) -> np.ndarray:
    """Labels of points that chains of steps of at most ``radius`` connect.

    All points of a cell whose diagonal is under the radius are near one another, so a cell is one node, and two cells are
    compared only while nothing connects them yet.
    """
    edge = radius / np.sqrt(at.shape[1]) * (1 - 1e-6)
    cell = np.floor((at - at.min(0)) / edge).astype(np.int64)
    cells, label = np.unique(cell, axis=0, return_inverse=True)
    order = np.argsort(label.ravel(), kind="stable")
    bounds = np.searchsorted(label.ravel()[order], np.arange(len(cells) + 1))
    rows = [order[bounds[i] : bounds[i + 1]] for i in range(len(cells))]
    number = {tuple(c): i for i, c in enumerate(cells.tolist())}
    parent = list(range(len(cells)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    far = int(np.ceil(np.sqrt(at.shape[1])))
    steps = sorted((o for o in product(range(-far, far + 1), repeat=at.shape[1]) if o > (0,) * at.shape[1]), key=lambda o: sum(x * x for x in o))
    for o in steps:  # near cells first
        for c, i in number.items():
            j = number.get(tuple(x + y for x, y in zip(c, o, strict=True)))
            if j is not None and (u := root(i)) != (v := root(j)) and _touch(at[rows[i]], at[rows[j]], radius):
                parent[max(u, v)] = min(u, v)
    return np.array([root(i) for i in range(len(cells))])[label.ravel()]


def _touch(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    step = max(1, PIECE // len(b))
    for at in range(0, len(a), step):
        d = (a[at : at + step, :1] - b[:, 0]) ** 2
        for k in range(1, a.shape[1]):
            d += (a[at : at + step, k : k + 1] - b[:, k]) ** 2
        if (np.sqrt(d) <= radius).any():
            return True
    return False


def near_links(rows: DataFrame, radius, frame: str = "t", key: str = "track_id", axes=AXES) -> DataFrame:
    """``frame, key, n_key``: every row with the smallest key that chains of near rows connect it to inside a block. The
    components of these links are those of all pairs within ``radius``."""
    kinds = dict(rows.dtypes)
    schema = f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, `n_{key}` {kinds[key]}"

    def work(_, near, r):
        near = by_key(near, key)
        label = joined_cells(points(near, axes), r)
        _, first, code = np.unique(label, return_index=True, return_inverse=True)
        keys = near.column(key)
        yield from pa.table([near.column(frame), keys, keys.take(pa.array(first[code]))], names=[frame, key, f"n_{key}"]).combine_chunks().to_batches()

    slim = rows.select(*dict.fromkeys([frame, key, *axes]))
    return near_blocks(slim, slim, radius, frame, axes, work, schema)


def near_correlation(rows: DataFrame, series: str, width: int, least: int, radius, frame: str = "t", key: str = "track_id", axes=AXES) -> DataFrame:
    """``frame, key, correlation``: the mean, over the other rows within ``radius``, of the correlation of two rows' lists of
    doubles, of the places that both have (at most ``width``); pairs with fewer than ``least``, or with a constant list there, do not count.

    A list is scaled to mean 0 and length 1 for each number of places, so the mean is that of products and no list is copied to
    a pair.
    """
    kinds = dict(rows.dtypes)
    names = [frame, key, "correlation"]
    schema = f"`{frame}` {kinds[frame]}, `{key}` {kinds[key]}, correlation double"

    def scaled(values: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` places, scaled, and 1 for lists that can be used there."""
        head = values[:, :n]
        with np.errstate(invalid="ignore", divide="ignore"):
            out = head - head.mean(axis=1, keepdims=True)
            out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
        good = (size >= n) & (head.max(axis=1) > head.min(axis=1)) & np.isfinite(out).all(axis=1)
        return np.column_stack([np.where(good[:, None], out, 0.0), good])

    def lists(table):
        column = table.column(series).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        size = np.diff(column.offsets.to_numpy())
        out = np.zeros((len(size), width))
        out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
        return out, size

    def work(mine, near, r):
        own, other = coded(mine, near, key)
        a, la = lists(mine)
        b, lb = lists(near)
        sizes = sorted(n for n in {*la.tolist(), *lb.tolist()} if n >= least)
        left, right = {n: scaled(a, la, n) for n in sizes}, {n: scaled(b, lb, n) for n in sizes}
        total, count = np.zeros(len(la)), np.zeros(len(la))
        for rows, others, _, within in visit(points(mine, axes), points(near, axes), r):
            within = (within & (own[rows, None] != other[others])).astype(float)
            lengths = lb[others]
            for n in np.unique(la[rows]):
                if n < least:
                    continue
                some = la[rows] == n
                here, these = rows[some], within[some]
                # longer lists meet at this row's length, shorter ones at theirs
                for m in [n, *(m for m in np.unique(lengths) if least <= m < n)]:
                    fit = lengths >= n if m == n else lengths == m
                    if not fit.any():
                        continue
                    got = these[:, fit] @ right[m][others[fit]] if not fit.all() else these @ right[m][others]
                    mineh = left[m][here]
                    total[here] += (got[:, :-1] * mineh[:, :-1]).sum(axis=1)
                    count[here] += got[:, -1] * mineh[:, -1]
        some = count > 0
        mean = np.divide(total, count, out=np.zeros(len(total)), where=some)
        yield from pa.table([mine.column(frame), mine.column(key), pa.array(mean)], names=names).filter(pa.array(some)).to_batches()

    slim = rows.select(*dict.fromkeys([frame, key, *axes, series]))
    return near_blocks(slim, slim, radius, frame, axes, work, schema)
