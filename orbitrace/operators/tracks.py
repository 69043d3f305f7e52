"""Per-track window and sequence operators. Tracks have ``track_id, t, x, y, z``; a track's rows are ordered by ``t``."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Start frames per track that tracklet ids leave room for.
TRACKLETS_PER_TRACK = 1 << 24


def in_track():
    """Window over the rows of a track in order; made when it is used, as a window needs a session."""
    return Window.partitionBy("track_id").orderBy("t")


def step_lengths(tracks: DataFrame) -> DataFrame:
    """``dx, dy, dz, step`` from the row before; null on a track's first row."""
    out = tracks.withColumns({f"d{a}": F.col(a) - F.lag(a).over(in_track()) for a in AXES})
    return out.withColumn("step", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))


def centered_rows(width: int, along=None):
    """A window of ``width`` rows about the current one; an even width has the longer half before it."""
    return (along or in_track()).rowsBetween(-(width // 2), (width - 1) // 2)


def preprocess_tracks(tracks: DataFrame, window: int = 5, move_thresh: float = 1.0, min_length: int = 0, stationary_share: float = 0.7) -> DataFrame:
    """Steps, trailing mean step, ``is_stationary`` per row (false where there is no step yet), ``track_length`` and
    ``mostly_stationary`` per track; tracks shorter than ``min_length`` go."""
    whole = Window.partitionBy("track_id")
    out = step_lengths(tracks).withColumn("mean_step", F.avg("step").over(in_track().rowsBetween(-(window - 1), 0)))
    out = out.withColumn("is_stationary", F.coalesce(F.col("mean_step") < move_thresh, F.lit(False)))
    out = out.withColumns({"track_length": F.count("*").over(whole), "mostly_stationary": F.avg(F.col("is_stationary").cast("int")).over(whole) > stationary_share})
    return out.where(F.col("track_length") >= min_length)


def rolling_mean(tracks: DataFrame, columns, width: int, suffix: str = "_mean") -> DataFrame:
    return tracks.withColumns({c + suffix: F.avg(c).over(centered_rows(width)) for c in columns})


def smooth_sphere(fits: DataFrame, width: int = 5, k: float = 2.0, columns=("center_x", "center_y", "center_z", "radius"), group: str = "well") -> DataFrame:
    """Centred means of sphere fits per well, and ``is_outlier`` where any residual is over ``k`` population deviations."""
    along, whole = Window.partitionBy(group).orderBy("t"), Window.partitionBy(group)
    out = fits.withColumns({f"{c}_smooth": F.avg(c).over(centered_rows(width, along)) for c in columns})
    out = out.withColumns({f"__r_{c}": F.col(c) - F.col(f"{c}_smooth") for c in columns})
    flags = [F.coalesce(F.abs(F.col(f"__r_{c}")) > k * F.stddev_pop(f"__r_{c}").over(whole), F.lit(False)) for c in columns]
    any_flag = flags[0]
    for f in flags[1:]:
        any_flag = any_flag | f
    return out.withColumn("is_outlier", any_flag).drop(*(f"__r_{c}" for c in columns))


@lru_cache(maxsize=64)
def savgol_weights(window: int, order: int) -> list[list[float]]:
    """Row ``p``: weights on the window's values for the fitted polynomial's value at place ``p`` of the window."""
    x = np.arange(window) - (window - 1) / 2
    powers = np.vander(x, order + 1, increasing=True)
    return (powers @ np.linalg.pinv(powers)).tolist()


def savgol(tracks: DataFrame, window: int = 5, order: int = 2, columns=AXES, suffix: str = "_s") -> DataFrame:
    """Savitzky-Golay smoothing per track; the edges take the polynomial fitted to the first or last window.

    Per track the window is ``min(window, n)`` made odd; tracks of fewer than 3 rows, or where the window is not over the
    order, stay as they are. The weights by (window, place) are a constant table in the plan.
    """
    whole = Window.partitionBy("track_id")
    out = tracks.withColumns({"__n": F.count("*").over(whole), "__i": F.row_number().over(in_track()) - 1})
    size = F.least(F.lit(window), F.col("__n"))
    out = out.withColumn("__w", size - F.when(size % 2 == 0, 1).otherwise(0))
    half = F.floor(F.col("__w") / 2).cast("int")
    # first row of the window that serves this row, and the row's place in it
    first = F.greatest(F.lit(0), F.least(F.col("__i") - half, F.col("__n") - F.col("__w"))).cast("int")
    out = out.withColumn("__shift", first - F.col("__i")).withColumn("__p", -F.col("__shift"))
    reach = in_track().rowsBetween(-(window - 1), window - 1)
    before = F.least(F.col("__i"), F.lit(window - 1))
    exprs = {}
    for c in columns:
        near = F.collect_list(F.coalesce(F.col(c), F.lit(float("nan")))).over(reach)
        value = F.col(c)
        for w in range(3, window + 1, 2):
            if w <= order:
                continue
            table = savgol_weights(w, order)
            for p in range(w):
                terms = [F.element_at(F.col(f"__l_{c}"), (F.col("__o") + k + 1).cast("int")) * table[p][k] for k in range(w)]
                total = terms[0]
                for term in terms[1:]:
                    total = total + term
                value = F.when((F.col("__w") == w) & (F.col("__p") == p), total).otherwise(value)
        exprs[c + suffix] = value
        out = out.withColumn(f"__l_{c}", near)
    out = out.withColumn("__o", before + F.col("__shift"))
    return out.withColumns(exprs).drop("__n", "__i", "__w", "__shift", "__p", "__o", *(f"__l_{c}" for c in columns))


def step_table(tracks: DataFrame, sphere: DataFrame, time: str = "time_min") -> DataFrame:
    """One row per pair of consecutive rows with a positive time difference: start, end, middle, velocity, angles.

    Coordinates are relative to the sphere centre of their own frame.
    """
    from orbitrace.functions.geometry import CENTER, centered, norm, to_spherical

    base = centered(tracks, sphere, "inner").drop(*CENTER, "radius_smooth", *AXES).withColumnsRenamed({f"d{a}": a for a in AXES})
    along = Window.partitionBy("track_id").orderBy(time)
    out = base.withColumns({f"{a}0": F.lag(a).over(along) for a in AXES} | {"time0": F.lag(time).over(along), "fluo0": F.lag("mean_fluo").over(along)})
    out = out.withColumn("dt", F.col(time) - F.col("time0")).where("dt > 0")
    out = out.withColumns({f"v{a}": (F.col(a) - F.col(f"{a}0")) / F.col("dt") for a in AXES} | {f"m{a}": (F.col(a) + F.col(f"{a}0")) / 2 for a in AXES})
    r, theta, phi = to_spherical(F.col("mx"), F.col("my"), F.col("mz"))
    n = F.greatest(norm(F.col("mx"), F.col("my"), F.col("mz")), F.lit(1e-12))
    out = out.withColumns({"radius": r, "theta": theta, "phi": phi, "mid_time": (F.col(time) + F.col("time0")) / 2, "mid_fluo": (F.col("mean_fluo") + F.col("fluo0")) / 2})
    return out.withColumns({f"u{a}": F.col(f"m{a}") / n for a in AXES}).select(
        "track_id", "t", "dt", "mid_time", *(f"{a}0" for a in AXES), *AXES, *(f"m{a}" for a in AXES), *(f"v{a}" for a in AXES), "ux", "uy", "uz", "theta", "phi", "radius", "mid_fluo",
    )


def path_and_net_speed(tracks: DataFrame, size: int, dt: float = 1.0) -> DataFrame:
    """Path speed over the ``size - 1`` steps of a centred window, net speed between its ends, and their ratio ``vi``."""
    half = size // 2
    out = step_lengths(tracks)
    inside = in_track().rowsBetween(-half + 1, half)
    whole = F.count("step").over(inside) == 2 * half
    path = F.when(whole, F.sum("step").over(inside) / (2 * half * dt))
    net = F.sqrt(sum(((F.lead(a, half).over(in_track()) - F.lag(a, half).over(in_track())) ** 2 for a in AXES), F.lit(0.0))) / (2 * half * dt)
    return out.withColumns({"path_speed": path, "net_speed": net}).withColumn("vi", F.col("net_speed") / F.col("path_speed"))


def tracklets(tracks: DataFrame, width: int, stride: int) -> DataFrame:
    """Pieces ``[t0, t0 + width)`` with ``t0`` a multiple of ``stride`` that hold exactly ``width`` rows of a track; the
    new id is made of track and start, so no ranking over all pieces is needed. A row goes to the few starts that can hold it."""
    low = F.greatest(F.ceil((F.col("t") - (width - 1)) / stride).cast("int"), F.lit(0))
    high = F.floor(F.col("t") / stride).cast("int")
    rows = tracks.where(low <= high).withColumn("t0", F.explode(F.sequence(low, high))).withColumn("t0", F.col("t0") * stride)
    piece = Window.partitionBy("track_id", "t0")
    whole = rows.withColumn("__n", F.count("*").over(piece)).where(F.col("__n") == width).drop("__n")
    return whole.withColumn("tracklet_id", F.col("track_id").cast("long") * TRACKLETS_PER_TRACK + F.col("t0"))


def from_origin(tracks: DataFrame, columns=AXES) -> DataFrame:
    return tracks.withColumns({f"{c}_rel": F.col(c) - F.first(c).over(in_track()) for c in columns})


def head_tail(tracks: DataFrame, n: int) -> DataFrame:
    """First and last ``n`` rows of each track, flagged ``is_head`` and ``is_tail``."""
    out = tracks.withColumns({
        "is_head": F.row_number().over(in_track()) <= n,
        "is_tail": F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("t"))) <= n,
    })
    return out.where("is_head OR is_tail")


def unit_step_velocity(tracks: DataFrame, center: tuple[str, str, str] | None = None) -> DataFrame:
    """Differences as velocities, the first row back-filled from the second; ``speed`` is their norm.

    With ``center``, the names of three columns, the part along the direction from it is taken off: velocities in the
    surface. A track of one row has none.
    """
    first = {f"v{a}": F.col(a) - F.lag(a).over(in_track()) for a in AXES}
    out = tracks.withColumns(first)
    out = out.withColumns({f"v{a}": F.coalesce(F.col(f"v{a}"), F.lead(f"v{a}").over(in_track())) for a in AXES})
    if center is not None:
        rel = {a: F.col(a) - F.col(c) for a, c in zip(AXES, center, strict=True)}
        square = sum((rel[a] * rel[a] for a in AXES), F.lit(0.0))
        along = F.try_divide(sum((F.col(f"v{a}") * rel[a] for a in AXES), F.lit(0.0)), square)
        out = out.withColumn("__along", along).withColumns({f"v{a}": F.col(f"v{a}") - F.coalesce("__along", F.lit(0.0)) * rel[a] for a in AXES}).drop("__along")
    return out.withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2))


def fill_frames(sparse: DataFrame, columns, key: str = "track_id", time: str = "t") -> DataFrame:
    """Every frame between a key's first and last, missing values interpolated linearly and flat beyond known ones."""
    span = sparse.groupBy(key).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    spine = span.select(key, F.explode(F.sequence("a", "b")).alias(time))
    out = spine.join(sparse.select(key, time, *columns), [key, time], "left")
    back = Window.partitionBy(key).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(time).rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(time))
        t0, t1 = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
        v0, v1 = F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
        mid = v0 + (v1 - v0) * (F.col(time) - t0) / (t1 - t0)
        out = out.withColumn(f"{c}_filled", F.coalesce(F.col(c), F.when(t0.isNull(), v1).when(t1.isNull(), v0).otherwise(mid)))
    return out


def drift(shifts: DataFrame, columns, key: str = "track_id", time: str = "t") -> DataFrame:
    """Running sum of per-frame shifts divided by the frame difference."""
    along = Window.partitionBy(key).orderBy(time)
    gap = F.coalesce(F.col(time) - F.lag(time).over(along), F.lit(1))
    out = shifts.withColumns({f"__{c}": F.col(c) / gap for c in columns})
    return out.withColumns({f"{c}_drift": F.sum(f"__{c}").over(along.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}).drop(*(f"__{c}" for c in columns))


def gaussian_smooth(tracks: DataFrame, column: str, sigma: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian over row places with the edge values repeated beyond the ends."""
    reach = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights = (weights / weights.sum()).tolist()
    whole = Window.partitionBy("track_id").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(column).over(whole), F.last(column).over(whole)
    total = F.lit(0.0)
    for k, w in zip(range(-reach, reach + 1), weights, strict=True):
        near = F.col(column) if k == 0 else F.lag(column, -k).over(in_track()) if k < 0 else F.lead(column, k).over(in_track())
        total = total + F.coalesce(near, first if k < 0 else last) * w
    return tracks.withColumn(f"{column}_smooth", total)


def resample(series: DataFrame, columns, step: float, key: str = "track_id", time: str = "t") -> DataFrame:
    """Values at each key's times ``first, first + step, ...`` up to its last one, linear between neighbouring rows.

    A row makes the new times from its own up to the next row's, so no grid is joined. Null values make null ones.
    """
    along = Window.partitionBy(key).orderBy(time)
    rows = series.select(key, time, *columns).withColumns({"__a": F.first(time).over(along), "__b": F.lead(time).over(along)} | {f"__n{c}": F.lead(c).over(along) for c in columns})
    low = F.ceil((F.col(time) - F.col("__a")) / step - 1e-9)
    # the last row makes its own time, if that is a new one
    high = F.when(F.col("__b").isNull(), F.floor((F.col(time) - F.col("__a")) / step + 1e-9)).otherwise(F.ceil((F.col("__b") - F.col("__a")) / step - 1e-9) - 1)
    made = rows.where(low <= high).withColumn("__k", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    new = F.col("__a") + F.col("__k") * step
    part = F.when(F.col("__b").isNotNull(), (new - F.col(time)) / (F.col("__b") - F.col(time)))
    mix = {c: F.when(F.col("__b").isNull(), F.col(c)).otherwise(F.col(c) + part * (F.col(f"__n{c}") - F.col(c))) for c in columns}
    return made.select(key, new.alias(time), *(v.alias(c) for c, v in mix.items()))


def islands(tracks: DataFrame, gap: int = 1, key: str = "track_id") -> DataFrame:
    """``segment``: 0 for a track's first run of frames, one more after each jump of over ``gap`` frames."""
    along = Window.partitionBy(key).orderBy("t")
    jump = (F.col("t") - F.lag("t").over(along) > gap).cast("int")
    return tracks.withColumn("__j", F.coalesce(jump, F.lit(0))).withColumn("segment", F.sum("__j").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("__j")


def break_at_jumps(tracks: DataFrame, thresh: float, axes=("x", "y")) -> DataFrame:
    """``piece``: raised where a coordinate moves by more than ``thresh`` between rows."""
    flag = F.lit(False)
    for a in axes:
        flag = flag | F.coalesce(F.abs(F.col(a) - F.lag(a).over(in_track())) > thresh, F.lit(False))
    return tracks.withColumn("__j", flag.cast("int")).withColumn("piece", F.sum("__j").over(in_track().rowsBetween(Window.unboundedPreceding, 0))).drop("__j")


def repair_timestamps(rows: DataFrame, key: str, order: str, time: str) -> DataFrame:
    """Times after the first jump of over twice the first step, extrapolated by the mean step of the second half before it."""
    along, whole = Window.partitionBy(key).orderBy(order), Window.partitionBy(key)
    out = rows.withColumns({"__i": F.row_number().over(along) - 1, "__d": F.col(time) - F.lag(time).over(along)})
    out = out.withColumn("__d0", F.max(F.when(F.col("__i") == 1, F.col("__d"))).over(whole))
    out = out.withColumn("__j", F.min(F.when(F.col("__d") > 2 * F.col("__d0"), F.col("__i"))).over(whole))
    inside = (F.col("__i") > F.floor(F.col("__j") / 2)) & (F.col("__i") < F.col("__j"))
    out = out.withColumns({
        "__m": F.coalesce(F.avg(F.when(inside, F.col("__d"))).over(whole), F.col("__d0")),
        "__last": F.max(F.when(F.col("__i") == F.col("__j") - 1, F.col(time))).over(whole),
    })
    fixed = F.when(F.col("__i") >= F.col("__j"), F.col("__last") + (F.col("__i") - F.col("__j") + 1) * F.col("__m")).otherwise(F.col(time))
    return out.withColumn(f"{time}_fixed", fixed).drop("__i", "__d", "__d0", "__j", "__m", "__last")


def coherence(tracks: DataFrame, width: int) -> DataFrame:
    """Contour length, net displacement and their ratio over ``width`` rows (odd); tracks that are shorter go."""
    half = width // 2
    out = step_lengths(tracks).withColumn("__n", F.count("*").over(Window.partitionBy("track_id"))).where(F.col("__n") >= width)
    inside = in_track().rowsBetween(-half + 1, half)
    contour = F.when(F.count("step").over(inside) == 2 * half, F.sum("step").over(inside))
    net = F.sqrt(sum(((F.lead(a, half).over(in_track()) - F.lag(a, half).over(in_track())) ** 2 for a in AXES), F.lit(0.0)))
    return out.withColumns({"contour": contour, "net": net}).withColumn("coherence", F.col("net") / F.col("contour")).drop("__n")
