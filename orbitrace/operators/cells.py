"""Per-cell measures from neighbours in the same frame."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.operators.blocks import near_correlation, near_sums
from orbitrace.operators.neighbors import nearest, radius_pairs
from orbitrace.operators.tracks import AXES, in_track


def neighbor_table(tracks: DataFrame, radius: float, values=()) -> DataFrame:
    """Pairs in a frame within ``radius``, with both ids, ``distance`` and the neighbours' ``values`` (self included)."""
    slim = tracks.select("track_id", "t", *AXES, *values)
    return radius_pairs(slim, slim, radius).select("t", "track_id", "n_track_id", "distance", *values, *(f"n_{v}" for v in values))


def local_density(tracks: DataFrame, radius: float, mean_of=(), include_self: bool = True, projected: bool = False, sphere_radius: float = 500.0) -> DataFrame:
    """Cells within ``radius`` per area, and the neighbours' mean of some columns. The area is a disk's, or a cap's where
    points were projected to the sphere."""
    area = 2 * math.pi * sphere_radius * radius if projected else math.pi * radius**2
    slim = tracks.select("track_id", "t", *AXES, *(F.col(c).cast("double").alias(c) for c in mean_of))
    sums = near_sums(slim, slim, radius, values=tuple(mean_of), include_self=include_self)
    means = (F.when(F.col(f"n_{c}") > 0, F.col(f"s_{c}") / F.col(f"n_{c}")).alias(f"{c}_nn") for c in mean_of)
    per = sums.select("track_id", "t", F.col("n").alias("n_near"), *means)
    out = tracks.join(per, ["track_id", "t"], "left")
    return out.withColumns({"n_near": F.coalesce("n_near", F.lit(0)), "density": F.coalesce("n_near", F.lit(0)) / F.lit(area)})


def knn_density(tracks: DataFrame, k: int, radius: float, least: int = 5) -> DataFrame:
    """``k / (pi r_k^2)`` with the distance to the k-th other cell; null in frames of under ``least`` cells or at distance 0."""
    near = nearest(tracks.select("track_id", "t", *AXES), tracks.select("track_id", "t", *AXES), k, radius, "track_id", include_self=False)
    per = near.groupBy("track_id", "t").agg(F.max("distance").alias("rk"), F.count("*").alias("found"))
    size = tracks.groupBy("t").agg(F.count("*").alias("__n"))
    out = tracks.join(size, "t").join(per, ["track_id", "t"], "left")
    good = (F.col("__n") >= least) & (F.col("rk") > 0)
    return out.withColumn("knn_density", F.when(good, F.col("found") / (math.pi * F.col("rk") * F.col("rk")))).drop("__n", "rk", "found")


def spherical_knn_density(units: DataFrame, k: int, angle: float, mode: str = "kth", alpha: float = 0.5, sphere_radius: float = 500.0) -> DataFrame:
    """Cells per cap on the sphere from the ``k`` nearest others of unit vectors ``ux, uy, uz``.

    ``kth`` takes the angle to the k-th, ``avg`` the mean angle, ``trimmed`` the angle to the ``ceil(alpha k)``-th, which then
    is also the count. The neighbours' sum and mean of ``mean_fluo`` leave the cell itself out.
    """
    slim = units.select("track_id", "t", "ux", "uy", "uz", "mean_fluo")
    near = nearest(slim, slim, k, 2 * math.sin(angle / 2), "track_id", axes=("ux", "uy", "uz"), include_self=False)
    near = near.withColumn("angle", 2 * F.asin(F.least(F.col("distance") / 2, F.lit(1.0))))
    q = math.ceil(alpha * k)
    size, count = {"kth": (F.max("angle"), F.count("*")), "avg": (F.avg("angle"), F.count("*")), "trimmed": (F.max(F.when(F.col("rank") <= q, F.col("angle"))), F.count(F.when(F.col("rank") <= q, 1)))}[mode]
    per = near.groupBy("track_id", "t").agg(size.alias("a"), count.alias("c"), F.avg("n_mean_fluo").alias("fluo_mean_nn"), F.sum("n_mean_fluo").alias("fluo_sum_nn"))
    area = 2 * math.pi * sphere_radius**2 * (1 - F.cos("a"))
    return per.select("track_id", "t", F.when(F.col("a") > 0, F.col("c") / area).alias("sphere_density"), "fluo_mean_nn", "fluo_sum_nn")


def degree_within(units: DataFrame, sphere: DataFrame, rho: float, k: int | None = None) -> DataFrame:
    """Other cells within surface distance ``rho`` among the k nearest, k by the frame's size: ``min(64, max(8, sqrt n))``.

    The angle is ``rho`` over the median radius of all fits.
    """
    radius = sphere.agg(F.percentile("radius_smooth", 0.5).alias("r")).first().r
    angle = rho / radius
    slim = units.select("track_id", "t", "ux", "uy", "uz")
    near = near_sums(slim, slim, 2 * math.sin(angle / 2), axes=("ux", "uy", "uz"), enough=64 if k is None else k)
    size = units.groupBy("t").agg(F.count("*").alias("n"))
    cap = F.least(F.lit(64), F.greatest(F.lit(8), F.floor(F.sqrt("n")))) if k is None else F.lit(k)
    per = near.withColumnRenamed("n", "c").join(size, "t")
    return per.select("track_id", "t", (F.least(F.col("c"), cap) - 1).alias("degree"))


def velocity_alignment(tracks: DataFrame, radius: float) -> DataFrame:
    """Mean cosine between a cell's velocity and those of the other cells within ``radius``; standing cells are left out."""
    moved = tracks.withColumns({f"v{a}": F.col(a) - F.lag(a).over(in_track()) for a in AXES})
    moved = moved.withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).where("speed > 0")
    # the mean of cosines with a cell is its direction times the sum of the others' directions
    moved = moved.select("track_id", "t", *AXES, *((F.col(f"v{a}") / F.col("speed")).alias(f"d{a}") for a in AXES))
    near = near_sums(moved, moved, radius, values=[f"d{a}" for a in AXES], include_self=False)
    per = near.join(moved.drop(*AXES), ["track_id", "t"])
    per = per.select("track_id", "t", (sum((F.col(f"d{a}") * F.col(f"s_d{a}") for a in AXES), F.lit(0.0)) / F.col("n")).alias("alignment"))
    return tracks.select("track_id", "t").join(per, ["track_id", "t"], "left")


def windowed_correlation(tracks: DataFrame, radius: float, half: int, vector: bool = False, least: int = 2) -> DataFrame:
    """Mean, over the other cells within ``radius``, of the correlation of two cells' speed (or velocity) series in
    ``[t - half, t + half]``, the values matched by place in the window.

    Fewer than ``least`` common values, or a series without variance, gives no correlation with that neighbour.
    """
    moved = tracks.withColumns({f"v{a}": F.col(a) - F.lag(a).over(in_track()) for a in AXES})
    moved = moved.withColumn("speed", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2))
    series = F.array("vx", "vy", "vz") if vector else F.array("speed")
    near_time = Window.partitionBy("track_id").orderBy("t").rangeBetween(-half, half)
    item = F.when(F.col("speed").isNotNull(), F.struct("t", series.alias("v")))
    listed = moved.withColumn("s", F.flatten(F.transform(F.sort_array(F.collect_list(item).over(near_time)), lambda x: x["v"])))
    per = near_correlation(listed, "s", (2 * half + 1) * (3 if vector else 1), least, radius)
    return tracks.select("track_id", "t").join(per, ["track_id", "t"], "left")


def knn_smooth(tracks: DataFrame, columns, k: int, radius: float, width: int = 5) -> DataFrame:
    """Centred mean over ``width`` rows, then the mean over the ``k`` nearest cells (self included); nulls are skipped."""
    from orbitrace.operators.tracks import rolling_mean

    rolled = rolling_mean(tracks, columns, width, "_t")
    slim = rolled.select("track_id", "t", *AXES, *(f"{c}_t" for c in columns))
    near = nearest(slim, slim, k, radius, "track_id")
    per = near.groupBy("track_id", "t").agg(*(F.avg(f"n_{c}_t").alias(f"{c}_knn") for c in columns))
    return rolled.join(per, ["track_id", "t"], "left").drop(*(f"{c}_t" for c in columns))
