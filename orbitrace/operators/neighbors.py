"""Neighbour joins inside frames, by equi joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.operators.blocks import near_first
from orbitrace.session import materialize, tasks_for

AXES = ("x", "y", "z")
#: Frames up to this size are covered by the first reach of a nearest search.
SMALL_FRAME = 256


def _cells(df: DataFrame, edge, axes) -> DataFrame:
    return df.withColumns({f"__c{a}": F.floor(F.col(a) / edge).cast("bigint") for a in axes})


def _offsets(k: int, axes) -> Column:
    """Array of structs with every offset of -k..k on each axis."""
    grid = [{}]
    for a in axes:
        grid = [g | {a: o} for g in grid for o in range(-k, k + 1)]
    return F.array(*(F.struct(*(F.lit(g[a]).cast("bigint").alias(a) for a in axes)) for g in grid))


def radius_pairs(left: DataFrame, right: DataFrame, radius, frame: str | None = "t", axes=AXES, reach: int = 1) -> DataFrame:
    """Pairs of rows of one frame whose points lie within ``radius``: all columns of ``left``, those of ``right`` with the
    prefix ``n_``, and ``distance``.

    Space is cut into cells with an edge of ``radius / reach``; a right row is copied to the cells around its own and meets
    left rows by an equi join, so the work follows the number of rows in neighbouring cells and no frame is one task.
    ``radius`` is a number, or a column that is the same for all rows of a frame on both sides. Rows with a null
    coordinate or frame pair with nothing.
    """
    edge = (F.lit(float(radius)) if not isinstance(radius, Column) else radius) / reach
    keys = ([frame] if frame else []) + [f"__c{a}" for a in axes]
    around = _cells(right, edge, axes).withColumn("__o", F.explode(_offsets(reach, axes)))
    around = around.withColumns({f"__c{a}": F.col(f"__c{a}") + F.col(f"__o.{a}") for a in axes}).drop("__o")
    renamed = around.select(*keys, *(F.col(f"`{c}`").alias(f"n_{c}") for c in right.columns))
    # the size that Spark takes for the copies is that of the rows before they were copied, so it would broadcast them
    joined = _cells(left, edge, axes).withColumn("__r", edge * reach).join(renamed.hint("merge"), keys)
    d2 = sum(((F.col(a) - F.col(f"n_{a}")) * (F.col(a) - F.col(f"n_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"n_{axes[0]}")) * (F.col(axes[0]) - F.col(f"n_{axes[0]}")))
    out = joined.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= F.col("__r"))
    return out.drop("__r", *(f"__c{a}" for a in axes))


def chord(angle):
    """Straight distance between unit vectors ``angle`` apart."""
    return 2 * F.sin((angle if isinstance(angle, Column) else F.lit(float(angle))) / 2)


def angular_pairs(units: DataFrame, angle, frame: str = "t", axes=("ux", "uy", "uz"), key: str = "track_id") -> DataFrame:
    """Pairs of different rows of a frame whose unit vectors are within ``angle`` (a number or a per-frame column)."""
    return radius_pairs(units, units, chord(angle), frame, axes).where(F.col(key) != F.col(f"n_{key}"))


def nearest(left: DataFrame, right: DataFrame, k: int, radius: float, key: str, frame: str = "t", axes=AXES, include_self: bool = True, rounds: int = 60, carry=(), fold=None) -> DataFrame:
    """The ``k`` nearest rows of a frame for each left row, with ``distance`` and ``rank`` (1 first; ties by ``n_key``).

    A search in rings of cells. The first reach follows each frame's density (``radius`` is only the edge of the cells it is
    measured on): a left row meets the rows of its own cell and of those around it, and is done when ``k`` of them are
    within the reach, as no nearer one can be further out. The others look again with twice the reach, and of the right
    rows only those in cells around them are sent; a row stops at the first reach that holds its ``k``, so no row meets its
    whole frame unless the reach has to cover it. Rows meet in blocks, and the ``k`` nearest alone leave a task, so no pair is written;
    the other columns are joined at the end. Rows with a null, NaN or infinite coordinate, or without a frame, take no part.
    With ``carry`` and ``fold`` (see ``near_first``) what leaves a task is one row for a left row, and nothing is joined.
    """
    wanted = k + (0 if include_self else 1)
    told = F.col(frame).isNotNull()
    for a in axes:
        told = told & F.col(a).isNotNull() & (F.abs(a) < float("inf")) & ~F.isnan(a)
    near = materialize(right.select(frame, key, *axes, *carry).where(told), "points")
    have = near.groupBy(frame).agg(F.count("*").alias("__have"), *(F.min(a).alias(f"__min{a}") for a in axes), *(F.max(a).alias(f"__max{a}") for a in axes))
    cells = _cells(near, float(radius), axes).groupBy(frame, *(f"__c{a}" for a in axes)).agg(F.count("*").alias("m"))
    # a row's own cell holds sum m^2 / sum m rows on average; about 2.5 times as many lie within one edge of it on a surface
    crowd = cells.groupBy(frame).agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("__own"))
    extent = F.greatest(*(F.col(f"__max{a}") - F.col(f"__min{a}") for a in axes), F.lit(1e-9))
    # a reach beyond the frame's extent would only make its cells larger
    first = F.least(float(radius) * F.sqrt(F.lit(2.0 * wanted) / (2.5 * F.col("__own"))), 2 * extent)
    first = F.when(F.col("__have") <= SMALL_FRAME, 2 * extent).otherwise(first)
    shape = materialize(have.join(crowd, frame).select(frame, "__have", first.alias("__first")), "frames")
    same = left is right
    asking = lambda df: df.join(shape, frame).withColumn("__want", F.least(F.lit(wanted), F.col("__have"))).drop("__have")
    todo = asking(near) if same else materialize(asking(left.select(frame, key, *axes, *carry).where(told)), "todo")

    done = None
    for step in range(rounds):
        reach = F.col("__first") * 2.0**step
        around = near.join(shape.select(frame, "__first"), frame).withColumn("__reach", reach)
        if step:
            cells_ = [f"__c{a}" for a in axes]
            asked = _cells(todo.withColumn("__reach", reach), F.col("__reach"), axes).select(frame, *cells_).distinct().withColumn("__o", F.explode(_offsets(1, axes)))
            asked = asked.select(frame, *((F.col(f"__c{a}") + F.col(f"__o.{a}")).alias(f"__c{a}") for a in axes)).distinct()
            around = _cells(around, F.col("__reach"), axes).join(asked.hint("merge"), [frame, *cells_], "left_semi").drop(*cells_)
        mine = todo.withColumn("__reach", reach)
        found = near_first(mine, mine if same and not step else around, k, F.col("__reach"), frame, key, axes, include_self, "__want", span=16, carry=carry, fold=fold)
        found = materialize(found, "near")
        got = found.where("__open IS NULL").drop("__open") if fold else found
        done = got if done is None else done.unionByName(got)
        # a row whose only candidate was itself has no rank, and looks again until its frame is covered
        if fold and same:  # each row is in a block with itself, which tells of those that look again
            rest = asking(found.where("__open IS NOT NULL").select(frame, key, "__open.*"))
        else:
            rest = todo.join(got.select(frame, key).distinct(), [frame, key], "left_anti")
        todo = materialize(rest.where((F.col("__want") > 1) | F.lit(include_self)), "todo")
        if not todo.limit(1).count():
            break
    if fold:
        return done
    out = done.join(left, [frame, key])
    other = right.select(F.col(frame), *(F.col(c).alias(f"n_{c}") for c in right.columns))
    if set(right.columns) <= {frame, key}:
        return out
    return out.join(other, [frame, f"n_{key}"])


def nearest_within(points: DataFrame, targets: DataFrame, cutoff: float, point_key: str, target_key: str, frame: str = "t", axes=AXES) -> DataFrame:
    """Each point with the key of its nearest target within ``cutoff``, or -1 (ties take the smallest key)."""
    slim = targets.select(frame, F.col(target_key).alias(point_key), *axes)
    best = near_first(points, slim, 1, cutoff, frame, point_key, axes).select(frame, point_key, F.col(f"n_{point_key}").alias("__k"))
    return points.join(best, [frame, point_key], "left").withColumn(f"nearest_{target_key}", F.coalesce("__k", F.lit(-1))).drop("__k")


def to_windows(df: DataFrame, time: str, window: float, stride: float, t_min: float, centers: int) -> DataFrame:
    """One row per window that holds the row: ``t_idx`` and ``time_center``; windows are ``window`` wide, ``stride`` apart.

    The indices that can hold a time are a short sequence, which is exploded; there is no join on an inequality.
    """
    half, at = window / 2, (F.col(time) - t_min) / stride
    low = F.greatest(F.ceil(at - half / stride - 1e-9), F.lit(0))
    high = F.least(F.floor(at + half / stride + 1e-9), F.lit(centers - 1))
    out = df.where(low <= high).withColumn("t_idx", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    return out.withColumn("time_center", F.col("t_idx") * stride + t_min).where(F.abs(F.col(time) - F.col("time_center")) <= half)


def lag_pairs(df: DataFrame, entity: str, time: str, lag: float, tolerance: float) -> DataFrame:
    """Pairs of one entity whose times differ by ``lag`` within a relative ``tolerance``; the later row has prefix ``n_``.

    Times are cut into buckets as wide as the longest difference, so a row meets its own and the next bucket only.
    """
    low, high = lag * (1 - tolerance), lag * (1 + tolerance)
    a = df.withColumn("__b", F.floor(F.col(time) / high).cast("bigint"))
    late = a.withColumn("__b", F.explode(F.array(F.col("__b"), F.col("__b") - 1)))
    late = late.select(entity, "__b", *(F.col(c).alias(f"n_{c}") for c in df.columns if c != entity))
    gap = F.col(f"n_{time}") - F.col(time)
    return a.join(late, [entity, "__b"]).where((gap >= low) & (gap <= high) & (gap > 0)).drop("__b")


def gap_pairs(ends: DataFrame, starts: DataFrame, gap_max: int, end_t: str = "t_end", start_t: str = "t_start") -> DataFrame:
    """Ends with the starts 1 to ``gap_max + 1`` frames later, by exploding the possible start frames."""
    wide = ends.withColumn(start_t, F.explode(F.sequence(F.col(end_t) + 1, F.col(end_t) + 1 + gap_max)))
    return wide.join(starts, start_t)


def near_gap_pairs(ends: DataFrame, starts: DataFrame, gap_max: int, distance: float) -> DataFrame:
    """Ends ``t_end, ex, ey, ez`` with the starts ``t_start, sx, sy, sz`` 1 to ``gap_max + 1`` frames later within ``distance``: the
    columns of both and ``distance``. They meet by start frame and grid cell, so other pairs are not formed."""
    wide = ends.withColumn("t_start", F.explode(F.sequence(F.col("t_end") + 1, F.col("t_end") + 1 + gap_max)))
    left = wide.withColumnsRenamed({f"e{a}": a for a in AXES})
    near = radius_pairs(left, starts.withColumnsRenamed({f"s{a}": a for a in AXES}), distance, "t_start")
    near = near.drop("n_t_start").withColumnsRenamed({a: f"e{a}" for a in AXES} | {f"n_{a}": f"s{a}" for a in AXES})
    return near.withColumnsRenamed({f"n_{c}": c for c in starts.columns if c not in ("t_start", "sx", "sy", "sz")})


def near_track(tracks: DataFrame, track_id: int, distance: float) -> DataFrame:
    """Ids of the tracks that come within ``distance`` of one track in some frame."""
    one = tracks.where(F.col("track_id") == track_id).select("t", *(F.col(a).alias(f"o{a}") for a in AXES))
    d2 = sum(((F.col(a) - F.col(f"o{a}")) * (F.col(a) - F.col(f"o{a}")) for a in AXES), F.lit(0.0))
    near = tracks.where(F.col("track_id") != track_id).join(one, "t").where(F.sqrt(d2) < distance)
    return near.select("track_id").distinct()


def label_overlap(a: DataFrame, b: DataFrame, keys=("t", "z", "y", "x"), label: str = "label") -> DataFrame:
    """``label, other_label, n``: voxels that both labelings hold.

    The pairs that meet are counted first, by the labels of a voxel on each side, and the number of tasks follows it: most
    pairs can be different ones, and a task that combines them would hold what its share of the voxels expands to.
    """
    parts = tasks_for(a.count() + b.count(), a)
    left, right = (df.select(*keys, F.col(label).alias(c)).repartition(parts, *keys).distinct() for df, c in ((a, label), (b, f"other_{label}")))
    many = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "__l"), (right, "__r"))]
    meet = many[0].join(many[1].hint("merge"), list(keys)).agg(F.sum(F.col("__l") * F.col("__r"))).first()[0] or 0
    pairs = left.join(right.hint("merge"), list(keys)).select(label, f"other_{label}")
    return pairs.repartition(tasks_for(meet, a), label, f"other_{label}").groupBy(label, f"other_{label}").agg(F.count("*").alias("n"))


def fragment_pairs(tracks: DataFrame, width: int) -> DataFrame:
    """Each row with the row of its track ``width - 1`` frames later, prefix ``n_``; both must be there."""
    later = tracks.select("track_id", (F.col("t") - (width - 1)).alias("t"), *(F.col(c).alias(f"n_{c}") for c in tracks.columns if c != "track_id"))
    return tracks.join(later, ["track_id", "t"])


def relabel(df: DataFrame, lookup: DataFrame, column: str = "track_id", old: str = "old_id", new: str = "new_id") -> DataFrame:
    """``column`` replaced by its new id where the lookup has one; a lookup that maps one id twice raises ``ValueError``."""
    twice = lookup.groupBy(old).agg(F.countDistinct(new).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{old} is mapped to more than one {new}")
    one = lookup.select(F.col(old).alias(column), F.col(new).alias("__new")).distinct()
    out = df.join(one, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
    return out.select(*df.columns)
