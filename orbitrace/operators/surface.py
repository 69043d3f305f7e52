"""Sphere fits per frame by rounds of aggregation, harmonic surfaces, and gridded surface statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.functions.geometry import angle_bins, real_harmonics
from orbitrace.functions.healpix import neighbor_rows, npix, pixel_neighbors, pixel_table, with_pixel
from orbitrace.operators.fields import small_broadcast
from orbitrace.operators.tracks import AXES
from orbitrace.session import materialize


def _det3(m):
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def solve3(m, b, least=1e-12):
    """Columns of the solution of a 3 by 3 system by Cramer's rule; null where the determinant is at most ``least``."""
    raw = _det3(m)
    det = F.when(F.abs(raw) > least, raw)
    return [_det3([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / det for k in range(3)]


def algebraic_sphere(points: DataFrame, frame: str = "t") -> DataFrame:
    """``center_x, center_y, center_z, radius`` per frame by linear least squares on ``x^2 + y^2 + z^2``.

    Coordinates are taken about the frame's mean first; one aggregation gives the mean and one the moments. A frame of
    fewer than four points, or of points in a plane, has no such sphere and gets nulls; an empty table gives no rows.
    """
    return _algebraic(points, frame).select(frame, *(f"center_{a}" for a in AXES), "radius")


def _algebraic(points: DataFrame, frame: str) -> DataFrame:
    """The algebraic fit, with the mean ``m*`` and the mean squared distance ``q`` from it."""
    mean = points.groupBy(frame).agg(*(F.avg(a).alias(f"m{a}") for a in AXES))
    p = points.join(mean, frame).select(frame, *(f"m{a}" for a in AXES), *((F.col(a) - F.col(f"m{a}")).alias(a) for a in AXES))
    p = p.withColumn("q", F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    s = p.groupBy(frame).agg(
        *(F.first(f"m{a}").alias(f"m{a}") for a in AXES), *(F.avg(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs), *(F.avg(F.col(a) * F.col("q")).alias(f"{a}q") for a in AXES),
        F.avg("q").alias("q"), F.count("*").alias("n"),
    )
    get = lambda a, b: F.col("".join(sorted((a, b))))
    flat = F.when(F.col("n") > 3, 1e-9 * 8 * F.col("xx") * F.col("yy") * F.col("zz"))
    c = solve3([[2 * get(a, b) for b in AXES] for a in AXES], [F.col(f"{a}q") for a in AXES], flat)
    s = s.withColumns({f"d{a}": v for a, v in zip(AXES, c, strict=True)})
    r = F.sqrt(F.col("q") + sum((F.col(f"d{a}") ** 2 for a in AXES), F.lit(0.0)))
    return s.select(frame, *((F.col(f"m{a}") + F.col(f"d{a}")).alias(f"center_{a}") for a in AXES), r.alias("radius"), *(f"m{a}" for a in AXES), "q")


def fit_sphere(points: DataFrame, frame: str = "t", rounds: int = 6, huber: float | None = None, fixed_radius: float | None = None, bounds: dict[str, tuple[float, float]] | None = None, quantile: float = 0.25) -> DataFrame:
    """Sphere per frame that minimises the variance of the radii: ``center_*, radius`` and ``inner_radius`` (a quantile).

    Starts from the algebraic fit, or the mean where there is none; every round is one aggregation over all frames of the Gauss-Newton normal equations.
    ``huber`` (a distance) gives far points less weight, ``fixed_radius`` keeps the radius, ``bounds`` clip the centre and
    radius after each round.
    """
    points = materialize(points.select(frame, *AXES), "points")
    start = {f"c{a}": F.coalesce(f"center_{a}", f"m{a}") for a in AXES} | {"radius": F.coalesce("radius", F.sqrt("q"))}
    cur = materialize(_algebraic(points, frame).select(frame, *(c.alias(n) for n, c in start.items())), "fit")
    if fixed_radius is not None:
        cur = cur.withColumn("radius", F.lit(float(fixed_radius)))
    for _ in range(rounds):
        p = points.select(frame, *AXES).join(cur, frame).withColumns({f"d{a}": F.col(a) - F.col(f"c{a}") for a in AXES})
        p = p.withColumn("d", F.greatest(F.sqrt(sum((F.col(f"d{a}") ** 2 for a in AXES), F.lit(0.0))), F.lit(1e-12)))
        res = F.col("d") - F.col("radius")
        w = F.lit(1.0) if huber is None else F.when(F.abs(res) <= huber, 1.0).otherwise(huber / F.abs(res))
        p = p.withColumns({f"g{a}": -F.col(f"d{a}") / F.col("d") for a in AXES} | {"w": w})
        total = F.sum("w")
        m = {a: F.sum(F.col("w") * F.col(f"g{a}")) / total for a in AXES}
        mean_d = F.sum(F.col("w") * F.col("d")) / total
        aggs = [mean_d.alias("md"), *(m[a].alias(f"m{a}") for a in AXES)]
        for i, a in enumerate(AXES):
            aggs += [(F.sum(F.col("w") * F.col(f"g{a}") * F.col(f"g{b}")) / total).alias(f"{a}{b}") for b in AXES[i:]]
            aggs.append((F.sum(F.col("w") * F.col(f"g{a}") * F.col("d")) / total).alias(f"{a}d"))
        s = p.groupBy(frame).agg(*aggs, *(F.first(f"c{a}").alias(f"c{a}") for a in AXES), F.first("radius").alias("radius"))
        get = lambda a, b: F.col("".join(sorted((a, b))))
        if fixed_radius is None:  # the best radius is the mean, so it drops out: central moments
            mat = [[get(a, b) - F.col(f"m{a}") * F.col(f"m{b}") for b in AXES] for a in AXES]
            rhs = [-(F.col(f"{a}d") - F.col(f"m{a}") * F.col("md")) for a in AXES]
        else:
            mat = [[get(a, b) for b in AXES] for a in AXES]
            rhs = [-(F.col(f"{a}d") - F.col(f"m{a}") * fixed_radius) for a in AXES]
        step = solve3(mat, rhs)
        new = {f"c{a}": F.col(f"c{a}") + F.coalesce(x, F.lit(0.0)) for a, x in zip(AXES, step, strict=True)}
        if fixed_radius is None:
            new["radius"] = F.col("md") + sum((F.col(f"m{a}") * F.coalesce(x, F.lit(0.0)) for a, x in zip(AXES, step, strict=True)), F.lit(0.0))
        for k, (low, high) in (bounds or {}).items():
            name = "radius" if k == "radius" else f"c{k}"
            new[name] = F.least(F.greatest(new.get(name, F.col(name)), F.lit(low)), F.lit(high))
        cur = materialize(s.select(frame, *(new.get(n, F.col(n)).alias(n) for n in ("cx", "cy", "cz", "radius"))), "fit")
    d = points.join(cur, frame).withColumn("d", F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in AXES), F.lit(0.0))))
    last = d.groupBy(frame).agg(*(F.first(f"c{a}").alias(f"center_{a}") for a in AXES), F.first("radius").alias("fitted"), F.avg("d").alias("mean_d"), F.percentile("d", quantile).alias("inner_radius"))
    keep = F.col("fitted") if fixed_radius is not None or huber is not None or bounds else F.col("mean_d")
    return last.select(frame, *(f"center_{a}" for a in AXES), keep.alias("radius"), "inner_radius")


def refit_inliers(points: DataFrame, most: float, frame: str = "t", **options) -> DataFrame:
    """Two passes: a robust fit, then a fit to the points within ``most`` of it."""
    first = fit_sphere(points, frame, huber=options.pop("huber", most), **options)
    near = points.join(first, frame)
    d = F.sqrt(sum(((F.col(a) - F.col(f"center_{a}")) ** 2 for a in AXES), F.lit(0.0)))
    return fit_sphere(near.where(F.abs(d - F.col("radius")) <= most).select(*points.columns), frame, **options)


def surface_distance_filter(points: DataFrame, most: float, frame: str = "t") -> DataFrame:
    """Points whose distance from the fitted centre is within ``most`` of the inner radius."""
    fit = fit_sphere(points, frame)
    d = F.sqrt(sum(((F.col(a) - F.col(f"center_{a}")) ** 2 for a in AXES), F.lit(0.0)))
    return points.join(fit, frame).where(F.abs(d - F.col("inner_radius")) <= most).select(*points.columns)


def harmonic_surface(points: DataFrame, nside: int = 4, l_max: int = 3, ridge: float = 1e-3, fill_cut: float = math.radians(30), near: int = 5, frame: str = "t") -> DataFrame:
    """Real harmonic coefficients of the radius over directions: ``t, coeffs`` in order of degree, then order.

    Points (``theta, phi, r``) are averaged per pixel; an empty pixel takes the Gaussian mean of its ``near`` nearest full
    pixels within ``fill_cut``, or else the frame's mean. What remains per frame, 12 nside^2 values, is solved in pandas.
    """
    spark = points.sparkSession
    pix = with_pixel(points.select(frame, "theta", "phi", "r"), nside).groupBy(frame, "pix").agg(F.avg("r").alias("v"), F.count("*").alias("n"))
    table = pixel_neighbors(spark, nside, fill_cut).where("pix <> near").select(F.col("near").alias("src"), F.col("pix").alias("dst"), "angle")
    cand = pix.select(frame, F.col("pix").alias("src"), "v").join(small_broadcast(table, neighbor_rows(nside, fill_cut)), "src")
    ranked = cand.withColumn("k", F.row_number().over(Window.partitionBy(frame, "dst").orderBy("angle", "src"))).where(F.col("k") <= near)
    w = F.exp(-0.5 * (F.col("angle") / (fill_cut / 2)) ** 2)
    filled = ranked.groupBy(frame, F.col("dst").alias("pix")).agg((F.sum(w * F.col("v")) / F.sum(w)).alias("fill"))
    # what a frame's solve reads: one row per pixel, by the contract of the fit
    spine = pix.groupBy(frame).agg(F.avg("v").alias("mean")).withColumn("pix", F.explode(F.sequence(F.lit(0), F.lit(npix(nside) - 1)).cast("array<bigint>")))
    spine = spine.join(small_broadcast(pixel_table(spark, nside), npix(nside)), "pix")
    full = spine.join(pix, [frame, "pix"], "left").join(filled, [frame, "pix"], "left")
    full = full.withColumns({"value": F.coalesce("v", "fill", "mean"), "weight": F.coalesce(F.col("n").cast("double"), F.lit(0.5))})
    basis = real_harmonics(l_max, F.col("theta_pix"), F.col("phi_pix"))
    rows = full.select(frame, "value", "weight", *(y.alias(f"y_{n}_{m + n}") for (n, m), y in basis.items()))
    names = [f"y_{n}_{m + n}" for n, m in basis]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, w = pdf[names].to_numpy(), pdf["weight"].to_numpy()
        c = np.linalg.solve(a.T @ (a * w[:, None]) + ridge * np.eye(a.shape[1]), a.T @ (w * pdf["value"].to_numpy()))
        return pd.DataFrame({frame: [pdf[frame].iloc[0]], "coeffs": [c.tolist()]})

    return rows.groupBy(frame).applyInPandas(solve, f"{frame} int, coeffs array<double>")


def evaluate_harmonics(points: DataFrame, coeffs: DataFrame, l_max: int = 3, frame: str = "t") -> DataFrame:
    """``r_fit`` at the points' directions."""
    basis = real_harmonics(l_max, F.col("theta"), F.col("phi"))
    total = F.lit(0.0)
    for k, y in enumerate(basis.values()):
        total = total + F.col("coeffs")[k] * y
    return points.join(coeffs, frame).withColumn("r_fit", total).drop("coeffs")


def grid_stats(points: DataFrame, value: str, n_theta: int = 19, n_phi: int = 36, frame: str = "t") -> DataFrame:
    """``t, i, j, n, sum, mean, max`` on a (theta, phi) grid; the nodes of a pole row are one place and share its value."""
    i, j = angle_bins(F.col("theta"), F.col("phi"), n_theta, n_phi)
    rows = points.select(frame, i.alias("i"), j.alias("j"), F.col(value).alias("v")).withColumn("j", F.when(F.col("i").isin(0, n_theta - 1), 0).otherwise(F.col("j")))
    return rows.groupBy(frame, "i", "j").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def smooth_grid(grid: DataFrame, sigma: float, n_theta: int = 19, n_phi: int = 36, frame: str = "t") -> DataFrame:
    """Gaussian mean over grid neighbours with weights ``n sin(theta)``; longitude wraps, rows reflect at the poles."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = F.broadcast(grid.sparkSession.createDataFrame(
        [(a, b, math.exp(-0.5 * (a * a + b * b) / sigma**2)) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)], "o_i int, o_j int, o_k double"
    ))  # its size depends on sigma alone
    rows = grid.join(kernel).withColumns({"i2": F.col("i") + F.col("o_i"), "j2": F.col("j") + F.col("o_j")})
    over = (F.col("i2") < 0) | (F.col("i2") > n_theta - 1)
    i2 = F.when(F.col("i2") < 0, -F.col("i2")).when(F.col("i2") > n_theta - 1, 2 * (n_theta - 1) - F.col("i2")).otherwise(F.col("i2"))
    j2 = F.pmod(F.col("j2") + F.when(over, n_phi // 2).otherwise(0), F.lit(n_phi))
    w = F.col("o_k") * F.col("n") * F.greatest(F.sin(F.col("i") * math.pi / (n_theta - 1)), F.lit(1e-3))
    rows = rows.select(frame, i2.alias("i"), j2.alias("j"), w.alias("w"), (w * F.col("mean")).alias("wv"))
    return rows.groupBy(frame, "i", "j").agg((F.sum("wv") / F.sum("w")).alias("smooth"))


def map_raster(points: DataFrame, value: str, bins: int = 64, north: bool = True) -> DataFrame:
    """Mean of a value on a square raster of the equal-area map of one half of the sphere: ``ix, iy, mean, n``."""
    from orbitrace.functions.geometry import in_disk, laea

    px, py = laea(F.col("theta"), F.col("phi"), north=north)
    side = math.sqrt(2)
    rows = points.select(px.alias("px"), py.alias("py"), F.col(value).alias("v")).where(in_disk(F.col("px"), F.col("py")))
    cell = lambda c: F.least(F.floor((F.col(c) + side) / (2 * side) * bins).cast("int"), F.lit(bins - 1))
    return rows.groupBy(cell("px").alias("ix"), cell("py").alias("iy")).agg(F.avg("v").alias("mean"), F.count("*").alias("n"))
