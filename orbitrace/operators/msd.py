"""Mean squared displacement and related sliding-window measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.operators.neighbors import lag_pairs
from orbitrace.operators.tracks import AXES, in_track


def _squared(prefix: str = "n_"):
    return sum(((F.col(f"{prefix}{a}") - F.col(a)) ** 2 for a in AXES), F.lit(0.0))


def msd_by_lag(tracks: DataFrame, lags, tolerance: float = 0.1, group=("track_id",), time: str = "time_min") -> DataFrame:
    """``group, lag, msd, n_pairs`` over all later points of a track whose time difference fits the lag."""
    slim = tracks.select(*dict.fromkeys(["track_id", time, *AXES, *group]))
    parts = [lag_pairs(slim, "track_id", time, lag, tolerance).groupBy(*group).agg(F.avg(_squared()).alias("msd"), F.count("*").alias("n_pairs")).withColumn("lag", F.lit(float(lag))) for lag in lags]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*group, "lag", "msd", "n_pairs")


def msd_exponent(msd: DataFrame, group=("track_id",), least_pairs: int = 3, least_lags: int = 2) -> DataFrame:
    """Log-log slope of the lags with enough pairs and a positive value."""
    good = msd.where((F.col("n_pairs") >= least_pairs) & (F.col("msd") > 0))
    out = good.groupBy(*group).agg(F.regr_slope(F.log("msd"), F.log("lag")).alias("alpha"), F.count("*").alias("n_lags"))
    return out.where(F.col("n_lags") >= least_lags)


def _indexed(tracks: DataFrame, columns=AXES) -> DataFrame:
    return tracks.select("track_id", (F.row_number().over(in_track()) - 1).alias("i"), "t", *columns)


def _windows(rows: DataFrame, width: int, step: int, last_too: bool) -> DataFrame:
    """Rows exploded to the window starts that hold them: 0, step, ... up to ``n - width`` (with or without the last)."""
    n = F.count("*").over(Window.partitionBy("track_id"))
    out = rows.withColumn("__n", n)
    low = F.greatest(F.ceil((F.col("i") - (width - 1)) / step), F.lit(0)).cast("long")
    top = F.floor((F.col("__n") - width - (0 if last_too else 1)) / step)
    high = F.least(F.floor(F.col("i") / step), top).cast("long")
    out = out.where(low <= high).withColumn("__s", F.explode(F.sequence(low, high)))
    return out.withColumn("start_idx", (F.col("__s") * step).cast("int")).drop("__n", "__s")


def sliding_msd(tracks: DataFrame, width: int = 20, step: int = 5, tau_max: int = 10) -> DataFrame:
    """``track_id, start_idx, tau, msd, n_obs`` per window of ``width`` rows, lags of 1 to ``tau_max`` rows.

    Steps and means are windows along the track, so a row is sent once and not copied to its windows and lags.
    """
    taus = range(1, min(tau_max, width - 1) + 1)
    if not taus:
        return tracks.select("track_id", F.lit(0).alias("start_idx"), F.lit(0).alias("tau"), F.lit(0.0).alias("msd"), F.lit(0).cast("long").alias("n_obs")).limit(0)
    along = in_track()
    rows = tracks.where("track_id IS NOT NULL").select("track_id", "t", *AXES)
    rows = rows.withColumns({"i": F.row_number().over(along) - 1, "__n": F.count("*").over(Window.partitionBy("track_id"))})
    rows = rows.withColumns({f"__d{k}": sum(((F.lead(a, k).over(along) - F.col(a)) ** 2 for a in AXES), F.lit(0.0)) for k in taus})
    # a window's pairs of one lag begin in its first width - lag rows
    rows = rows.withColumns({f"__m{k}": F.avg(f"__d{k}").over(along.rowsBetween(0, width - 1 - k)) for k in taus})
    rows = rows.where((F.col("i") % step == 0) & (F.col("i") + width <= F.col("__n")))
    each = F.array(*(F.struct(F.lit(k).alias("tau"), F.col(f"__m{k}").alias("msd"), F.lit(width - k).cast("long").alias("n_obs")) for k in taus))
    return rows.select("track_id", F.col("i").cast("int").alias("start_idx"), F.inline(each))


def auto_tau_max(width: int, least: int = 3) -> int:
    return max(1, min(width - least, width // 3))


def window_exponents(msd: DataFrame, taus: tuple[int, int] = (1, 10), least: int = 3) -> DataFrame:
    """``alpha`` and ``r2`` of the log-log fit per window over the lags in ``taus``; null under ``least`` points."""
    good = msd.where((F.col("msd") > 0) & F.col("tau").between(*taus))
    x, y = F.log(F.col("tau").cast("double")), F.log("msd")
    fit = good.groupBy("track_id", "start_idx").agg(F.regr_slope(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    return fit.select("track_id", "start_idx", *(F.when(F.col("n") >= least, F.col(c)).alias(c) for c in ("alpha", "r2")))


def sliding_persistence(tracks: DataFrame, width: int = 20, step: int = 5) -> DataFrame:
    """Lag-1 autocorrelation ``c1`` of the steps and mean cosine of turning per window; the last start is left out."""
    v = _indexed(tracks).withColumns({f"v{a}": F.lead(a).over(Window.partitionBy("track_id").orderBy("i")) - F.col(a) for a in AXES})
    v = v.withColumns({f"w{a}": F.lead(f"v{a}").over(Window.partitionBy("track_id").orderBy("i")) for a in AXES})
    rows = _windows(v, width, step, False).withColumn("k", F.col("i") - F.col("start_idx")).where(F.col("k") < width - 1)
    dot = sum((F.col(f"v{a}") * F.col(f"w{a}") for a in AXES), F.lit(0.0))
    nv, nw = (sum((F.col(f"{p}{a}") ** 2 for a in AXES), F.lit(0.0)) for p in "vw")
    inside = F.col("k") < width - 2
    return rows.groupBy("track_id", "start_idx").agg(
        (F.sum(F.when(inside, dot)) / F.sum(nv)).alias("c1"), F.avg(F.when(inside & (nv > 0) & (nw > 0), dot / F.sqrt(nv * nw))).alias("mean_cos"),
    )


def alpha_at_rows(tracks: DataFrame, exponents: DataFrame, width: int = 20) -> DataFrame:
    """Window exponents at the windows' middle times, interpolated to each row's ``t``; flat beyond the first and last."""
    rows = _indexed(tracks, ())
    mids = exponents.where("alpha IS NOT NULL").select("track_id", (F.col("start_idx") + width // 2).alias("i"), "alpha")
    out = rows.join(mids, ["track_id", "i"], "left")
    back = Window.partitionBy("track_id").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("track_id").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("alpha").isNotNull(), F.col("t"))
    out = out.withColumns({
        "t0": F.last(at, True).over(back), "a0": F.last("alpha", True).over(back), "t1": F.first(at, True).over(ahead), "a1": F.first("alpha", True).over(ahead),
    })
    mid = F.when(F.col("t1") == F.col("t0"), F.col("a0")).otherwise(F.col("a0") + (F.col("a1") - F.col("a0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0")))
    value = F.when(F.col("t0").isNull(), F.col("a1")).when(F.col("t1").isNull(), F.col("a0")).otherwise(mid)
    return out.select("track_id", "t", value.alias("alpha"))


def lead_lag(tracks: DataFrame, a: str, b: str, lags: int = 3, least: int = 10) -> DataFrame:
    """Correlation of centred ``a`` with ``b`` shifted by -lags..lags rows per track, over the whole track's deviations."""
    whole = Window.partitionBy("track_id")
    rows = tracks.select("track_id", (F.row_number().over(in_track()) - 1).alias("i"), F.col(a).alias("a"), F.col(b).alias("b"))
    rows = rows.withColumns({
        "n": F.count("*").over(whole), "ca": F.col("a") - F.avg("a").over(whole), "cb": F.col("b") - F.avg("b").over(whole),
        "sa": F.stddev_pop("a").over(whole), "sb": F.stddev_pop("b").over(whole),
    }).where(F.col("n") >= least)
    left = rows.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).withColumn("j", F.col("i") + F.col("lag"))
    right = rows.select("track_id", F.col("i").alias("j"), F.col("cb").alias("nb"))
    out = left.join(right, ["track_id", "j"]).groupBy("track_id", "lag").agg(F.avg(F.col("ca") * F.col("nb")).alias("m"), F.max("sa").alias("sa"), F.max("sb").alias("sb"))
    return out.select("track_id", "lag", F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("m") / (F.col("sa") * F.col("sb"))).alias("corr"))
