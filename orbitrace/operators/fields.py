"""HEALPix fields in sliding windows: counts, densities, flow, alignment, diffusivity, flux."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.functions.geometry import angle_between, tangent_basis
from orbitrace.functions.healpix import neighbor_rows, npix, pixel_area, pixel_neighbors, pixel_table, with_pixel
from orbitrace.session import materialize

#: A pixel table is broadcast up to this many rows; beyond it the join shuffles.
BROADCAST_PIXELS = 500_000
ENTROPY_BINS = 36
#: Steps of one block of a pixel at most, on average.
BLOCK_ROWS = 131_072
#: Steps of a block that are compared with as many others at a time.
PAIR_ROWS = 256
#: Steps of the cosine from -1 to 1 in the table of bins.
COSINES = 65_536


def small_broadcast(table: DataFrame, rows: float) -> DataFrame:
    """``table`` marked for a broadcast if it has at most ``BROADCAST_PIXELS`` rows."""
    return F.broadcast(table) if rows <= BROADCAST_PIXELS else table


def on_pixels(df: DataFrame, nside: int) -> DataFrame:
    """``df`` with its pixel of (theta, phi) and that pixel's centre."""
    return with_pixel(df, nside).join(small_broadcast(pixel_table(df.sparkSession, nside), npix(nside)), "pix")


def window_centers(times: DataFrame, time: str, stride: float) -> tuple[float, int]:
    """First centre and number of centres of ``min, min + s, ...`` up to at most one stride past the last time."""
    r = times.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    if r.a is None:
        return 0.0, 0
    s = max(1.0, stride)
    return float(r.a), math.ceil((r.b + s - r.a) / s - 1e-9)


def with_panes(df: DataFrame, time: str, window: float, stride: float, centers: tuple[float, int] | None = None) -> DataFrame:
    """``df`` with its pane: ``w_lo`` and ``w_hi``, the first and the last of the sliding windows that hold the row's time.

    All rows of a pane are in the same windows, and there are at most twice as many panes as windows. What can be summed is
    summed by pane first and by window then, so a row is never copied into its windows.
    """
    step, half = max(1.0, stride), window / 2
    t_min, n = centers or window_centers(df, time, stride)
    at = (F.col(time) - t_min) / step
    low = F.greatest(F.ceil(at - half / step - 1e-9), F.lit(0)).cast("int")
    high = F.least(F.floor(at + half / step + 1e-9), F.lit(max(n, 1) - 1)).cast("int")
    out = lambda k: (F.abs(F.col(time) - (k * step + t_min)) > half).cast("int")
    # the slack takes in one window too many at most, at either end
    bounds = F.struct((low + out(low)).alias("lo"), (high - out(high)).alias("hi"))
    made = df.withColumn("__w", F.when(low <= high, bounds)).where("__w.lo <= __w.hi")
    return made.select(*df.columns, F.col("__w.lo").alias("w_lo"), F.col("__w.hi").alias("w_hi"))


def by_window(rows: DataFrame, keys: list[str], sums: dict[str, Column], largest: dict[str, Column] | None = None) -> DataFrame:
    """``t_idx``, ``keys``, the sums of columns over the rows with panes in every window, and their largest values."""
    largest = largest or {}
    per = rows.groupBy("w_lo", "w_hi", *keys).agg(*(F.sum(c).alias(k) for k, c in sums.items()), *(F.max(c).alias(k) for k, c in largest.items()))
    wide = per.withColumn("t_idx", F.explode(F.sequence("w_lo", "w_hi")))
    return wide.groupBy("t_idx", *keys).agg(*(F.sum(k).alias(k) for k in sums), *(F.max(k).alias(k) for k in largest))


def window_counts(df: DataFrame, nside: int, window: float, stride: float, time: str = "time_min") -> DataFrame:
    """``t_idx, time_center, pix, n``: rows by pixel of (theta, phi) in sliding windows; empty pixels have no row."""
    t_min, n = window_centers(df, time, stride)
    rows = with_panes(with_pixel(df.select(time, "theta", "phi"), nside), time, window, stride, (t_min, n))
    out = by_window(rows, ["pix"], {"n": F.lit(1).cast("long")})
    return out.select("t_idx", (F.col("t_idx") * max(1.0, stride) + t_min).alias("time_center"), "pix", "n")


def pixel_stats(df: DataFrame, nside: int, value: str) -> DataFrame:
    """``t, pix, n, sum, mean, max`` of a value by pixel and frame."""
    rows = with_pixel(df.select("t", "theta", "phi", F.col(value).alias("v")), nside)
    return rows.groupBy("t", "pix").agg(F.count("*").alias("n"), F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.max("v").alias("max"))


def pixel_density(df: DataFrame, nside: int, radius: float = 1.0, outlier: str | None = None, mean_of=()) -> DataFrame:
    """``t, pix, n, density`` (per area), with means of some columns over the rows that are no outliers."""
    rows = with_pixel(df, nside)
    good = F.lit(True) if outlier is None else ~F.col(outlier)
    return rows.groupBy("t", "pix").agg(
        F.count("*").alias("n"), (F.count("*") / pixel_area(nside, radius)).alias("density"), *(F.avg(F.when(good, F.col(c))).alias(f"mean_{c}") for c in mean_of)
    )


def spread_to_pixels(steps: DataFrame, nside: int, sigma: float, window: float, stride: float, least: float, centers: tuple[float, int] | None = None) -> DataFrame:
    """Steps with their pane, in every pixel within two sigmas, with the Gaussian weight ``w`` of their angle, over ``least``.

    Steps meet their pixel's neighbour list by an equi join on the pixel, then the weight is exact. A weight does not
    depend on the window.
    """
    spark = steps.sparkSession
    rows = with_panes(with_pixel(steps, nside, name="home"), "mid_time", window, stride, centers)
    reach = 2 * sigma + math.sqrt(math.pi / 3) / nside
    near = pixel_neighbors(spark, nside, reach).select(F.col("pix").alias("home"), F.col("near").alias("pix"))
    table = near.join(small_broadcast(pixel_table(spark, nside), npix(nside)), "pix")
    out = rows.join(small_broadcast(table, neighbor_rows(nside, reach)), "home")
    angle = angle_between((F.col("ux"), F.col("uy"), F.col("uz")), (F.col("nx"), F.col("ny"), F.col("nz")))
    out = out.withColumn("angle", angle).where(F.col("angle") <= 2 * sigma)
    return out.withColumn("w", F.exp(-0.5 * (F.col("angle") / sigma) ** 2)).where(F.col("w") > least)


def density_field(steps: DataFrame, nside: int, sigma: float, window: float = 45.0, stride: float = 1.5, radius: float = 1.0, dense: bool = False) -> DataFrame:
    """``t_idx, pix, density, fluo``: summed weights per pixel area and distinct time of the window, weighted mean value.

    A pixel without a step in a window that has steps is 0: with ``dense`` it has a row with density 0 and a null value,
    otherwise none. A window without steps is missing in both.
    """
    centers = window_centers(steps, "mid_time", stride)
    w = spread_to_pixels(steps, nside, sigma, window, stride, 1e-2, centers)
    per = by_window(w, ["pix"], {"s": F.col("w"), "f": F.col("w") * F.col("mid_fluo")})
    times = by_window(with_panes(steps.select("mid_time").distinct(), "mid_time", window, stride, centers), [], {"k": F.lit(1).cast("long")})
    if dense:
        every = times.withColumn("pix", F.explode(F.sequence(F.lit(0), F.lit(npix(nside) - 1)).cast("array<bigint>")))
        rows = every.join(per, ["t_idx", "pix"], "left")
    else:
        rows = per.join(times, "t_idx")
    density = F.coalesce("s", F.lit(0.0)) / pixel_area(nside, radius) / F.col("k")
    return rows.select("t_idx", "pix", density.alias("density"), (F.col("f") / F.col("s")).alias("fluo"))


def tangent_coordinates(weighted: DataFrame, radius: float) -> DataFrame:
    """Position ``u, v`` and velocity ``vu, vv`` of the steps in their pixel's tangent plane."""
    e, f = tangent_basis((F.col("nx"), F.col("ny"), F.col("nz")))
    names = [f"__{k}{a}" for k in "ef" for a in "xyz"]
    based = weighted.withColumns(dict(zip(names, (*e, *f), strict=True)) | {f"__p{a}": F.col(f"m{a}") - radius * F.col(f"n{a}") for a in "xyz"})
    dot = lambda p, q: F.col(f"{p}x") * F.col(f"__{q}x") + F.col(f"{p}y") * F.col(f"__{q}y") + F.col(f"{p}z") * F.col(f"__{q}z")
    made = F.struct(dot("__p", "e").alias("u"), dot("__p", "f").alias("v"), dot("v", "e").alias("vu"), dot("v", "f").alias("vv"))
    # a filter on the coordinates stays above a generator; pushed below, it would repeat the whole basis
    out = based.select(*weighted.columns, F.explode(F.array(made)).alias("__m"))
    return out.select(*weighted.columns, "__m.u", "__m.v", "__m.vu", "__m.vv")


def _solve3(s: dict[str, Column], a: Column, b: Column, c: Column, det: Column) -> tuple[Column, Column, Column]:
    """Cramer's rule for the symmetric system with rows (w, u, v), (u, uu, uv), (v, uv, vv)."""
    k0 = a * (s["uu"] * s["vv"] - s["uv"] * s["uv"]) - s["u"] * (b * s["vv"] - s["uv"] * c) + s["v"] * (b * s["uv"] - s["uu"] * c)
    k1 = s["w"] * (b * s["vv"] - s["uv"] * c) - a * (s["u"] * s["vv"] - s["uv"] * s["v"]) + s["v"] * (s["u"] * c - b * s["v"])
    k2 = s["w"] * (s["uu"] * c - b * s["uv"]) - s["u"] * (s["u"] * c - b * s["v"]) + a * (s["u"] * s["uv"] - s["uu"] * s["v"])
    return k0 / det, k1 / det, k2 / det


def vector_field(steps: DataFrame, nside: int, sigma: float, radius: float, window: float = 45.0, stride: float = 1.5, least_steps: int = 6) -> DataFrame:
    """Weighted affine fit of the tangent velocity per window and pixel: ``drift_u, drift_v, j00..j11, divergence, curl``.

    Each pixel needs a step of its own and ``least_steps`` weights over 1e-3. The fit is twelve weighted sums and a
    closed 3 by 3 solve; a singular one gives nulls. ``curl`` is ``j10 - j01`` in the left-handed tangent basis, minus the
    outward curl.
    """
    t = tangent_coordinates(spread_to_pixels(steps, nside, sigma, window, stride, 1e-3), radius)
    w = F.col("w")
    terms = {"w": w, "u": w * F.col("u"), "v": w * F.col("v"), "uu": w * F.col("u") ** 2, "uv": w * F.col("u") * F.col("v"), "vv": w * F.col("v") ** 2}
    for c in ("vu", "vv"):
        terms |= {f"{c}_1": w * F.col(c), f"{c}_u": w * F.col(c) * F.col("u"), f"{c}_v": w * F.col(c) * F.col("v")}
    own = (F.col("home") == F.col("pix")).cast("int")
    sums = by_window(t, ["pix"], {f"s_{k}": x for k, x in terms.items()} | {"n_steps": F.lit(1).cast("long")}, {"own": own})
    sums = sums.where((F.col("n_steps") >= least_steps) & (F.col("own") == 1))
    s = {k: F.col(f"s_{k}") for k in terms}
    raw = s["w"] * (s["uu"] * s["vv"] - s["uv"] ** 2) - s["u"] * (s["u"] * s["vv"] - s["uv"] * s["v"]) + s["v"] * (s["u"] * s["uv"] - s["uu"] * s["v"])
    sums = sums.withColumn("det", F.when(F.abs(raw) > 1e-9 * s["w"] * s["uu"] * s["vv"], raw))
    d = F.col("det")
    au, bu, cu = _solve3(s, s["vu_1"], s["vu_u"], s["vu_v"], d)
    av, bv, cv = _solve3(s, s["vv_1"], s["vv_u"], s["vv_v"], d)
    out = sums.select("t_idx", "pix", "n_steps", au.alias("drift_u"), bu.alias("j00"), cu.alias("j01"), av.alias("drift_v"), bv.alias("j10"), cv.alias("j11"))
    return out.withColumns({"divergence": F.col("j00") + F.col("j11"), "curl": F.col("j10") - F.col("j01"), "drift_speed": F.sqrt(F.col("drift_u") ** 2 + F.col("drift_v") ** 2)})


def path_speed(steps: DataFrame, nside: int, sigma: float, radius: float, window: float = 45.0, stride: float = 1.5, least_steps: int = 6) -> DataFrame:
    """Weighted mean tangent speed per window and pixel with at least ``least_steps`` weights over 1e-2."""
    t = tangent_coordinates(spread_to_pixels(steps, nside, sigma, window, stride, 1e-2), radius)
    speed = F.sqrt(F.col("vu") ** 2 + F.col("vv") ** 2)
    out = by_window(t, ["pix"], {"ws": F.col("w") * speed, "w": F.col("w"), "n_steps": F.lit(1).cast("long")})
    return out.select("t_idx", "pix", (F.col("ws") / F.col("w")).alias("path_speed"), "n_steps").where(F.col("n_steps") >= least_steps)


def pair_alignment(steps: DataFrame, nside: int, sigma: float, window: float = 45.0, stride: float = 1.5) -> DataFrame:
    """Weighted mean cosine between the velocities of all step pairs of a window and pixel, from sums alone: no pair is formed."""
    t = _headings(steps, nside, sigma, window, stride)
    w = F.col("w")
    q = by_window(t, ["pix"], {a: w * F.col(f"h{a}") for a in "xyz"} | {"w": w, "w2": w * w, "n": F.lit(1).cast("long")})
    below = F.col("w") ** 2 - F.col("w2")
    length = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    return q.where("n > 1").select("t_idx", "pix", F.when(below > 0, (length - F.col("w2")) / below).alias("alignment"))


def _headings(steps: DataFrame, nside: int, sigma: float, window: float, stride: float) -> DataFrame:
    """``w_lo, w_hi, pix, w`` and the direction ``hx, hy, hz`` of every step faster than 1e-6."""
    t = spread_to_pixels(steps, nside, sigma, window, stride, 1e-2)
    t = t.withColumn("s", F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)).where("s > 1e-6")
    return t.select("w_lo", "w_hi", "pix", "w", *((F.col(f"v{a}") / F.col("s")).alias(f"h{a}") for a in "xyz"))


def angle_histogram(h: np.ndarray, w: np.ndarray, g: np.ndarray, v: np.ndarray, bins: int, own: bool) -> np.ndarray:
    """Summed ``w[i] * v[j]`` of the unit vectors ``h[i]``, ``g[j]`` by their angle, in ``bins`` on [0, pi]; with ``own`` both
    are the same and only ``i < j`` count.

    The bin is looked up by the cosine; only cosines in a step that holds the edge of a bin are turned into angles.
    """
    place = lambda c: np.minimum((np.arccos(np.clip(c, -1, 1)) * (bins / math.pi)).astype(np.int64), bins - 1)
    half = COSINES / 2
    at = np.arange(COSINES + 1) / half - 1
    low, high = place(at - 1e-9), place(at + 1 / half + 1e-9)
    table = np.where(low == high, low, bins)
    out = np.zeros(bins + 1)
    for a in range(0, len(h), PAIR_ROWS):
        for b in range(a if own else 0, len(g), PAIR_ROWS):
            cos, weight = (h[a : a + PAIR_ROWS] @ g[b : b + PAIR_ROWS].T).ravel(), np.outer(w[a : a + PAIR_ROWS], v[b : b + PAIR_ROWS])
            if own and a == b:
                weight = np.triu(weight, 1)
            weight = weight.ravel()
            found = table[((cos + 1) * half).astype(np.int64)]
            out += np.bincount(found, weight, bins + 1)
            open_ = np.flatnonzero(found == bins)
            out[:bins] += np.bincount(place(cos[open_]), weight[open_], bins)
    return out[:bins]


def misalignment_entropy(steps: DataFrame, nside: int, sigma: float, window: float = 45.0, stride: float = 1.5, bins: int = ENTROPY_BINS) -> DataFrame:
    """``t_idx, pix, entropy``: entropy over ln ``bins`` of the angles between the velocities of all step pairs of a window
    and pixel, weighted by the product of the steps' weights, in ``bins`` on [0, pi] (the last one closed).

    Each pair is compared once, however many windows hold it. A pixel's steps are cut into segments as long as a step's
    windows reach, so that only steps of one segment or of two adjoining ones share a window, and those into blocks of
    about ``BLOCK_ROWS``. A step is sent to every block that its own meets, so blocks are as large as a task can hold. There
    panes meet, ``PAIR_ROWS`` by ``PAIR_ROWS`` steps at a time, and one histogram a window is all that leaves the task. No pair
    becomes a row and no task sees a whole pixel; the work still grows with the square of the steps of a window. A pixel
    with fewer than two moving steps has no row.
    """
    span = int(window / max(1.0, stride)) + 1
    rows = _headings(steps, nside, sigma, window, stride).withColumn("seg", F.floor(F.col("w_lo") / span).cast("int"))
    rows = materialize(rows, "headings")
    size = rows.groupBy("pix", "seg").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("nb"))
    size = materialize(size, "sizes")
    later = size.select("pix", (F.col("seg") - 1).alias("seg"), F.col("nb").alias("nb2"))
    pairs = size.select("pix", F.col("seg").alias("s1"), F.col("seg").alias("s2"), F.col("nb").alias("nb1"), F.col("nb").alias("nb2")).unionByName(
        size.join(later, ["pix", "seg"]).select("pix", F.col("seg").alias("s1"), (F.col("seg") + 1).alias("s2"), F.col("nb").alias("nb1"), "nb2")
    )
    pairs = pairs.withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("nb1") - 1))).withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("nb2") - 1)))
    pairs = materialize(pairs.where("s1 < s2 OR b1 <= b2").select("pix", "s1", "b1", "s2", "b2"), "blocks")
    rows = rows.join(size, ["pix", "seg"]).withColumn("block", F.pmod(F.xxhash64("w_lo", "w", "hx", "hy", "hz"), F.col("nb")).cast("int")).drop("nb")
    side = lambda k, df: rows.join(df.withColumns({"seg": F.col(f"s{k}"), "block": F.col(f"b{k}")}), ["pix", "seg", "block"]).drop("seg", "block").withColumn("side", F.lit(k))
    placed = side(1, pairs).unionByName(side(2, pairs.where("s1 < s2 OR b1 < b2")))

    def panes(pdf: pd.DataFrame) -> list[tuple]:
        return [(*at, p[["hx", "hy", "hz"]].to_numpy(), p["w"].to_numpy()) for at, p in pdf.groupby(["w_lo", "w_hi"])]

    def histogram(pdf: pd.DataFrame) -> pd.DataFrame:
        k = pdf.iloc[0]
        alone = (k["s1"], k["b1"]) == (k["s2"], k["b2"])
        one = panes(pdf[pdf["side"] == 1])
        two = one if alone else panes(pdf[pdf["side"] == 2])
        base = pdf["w_lo"].min()
        sums = np.zeros((pdf["w_hi"].max() - base + 1, bins))
        for i, (lo, hi, h, w) in enumerate(one):
            for j, (lo2, hi2, h2, w2) in enumerate(two):
                first, last = max(lo, lo2), min(hi, hi2)
                if first <= last and not (alone and j < i):
                    sums[first - base : last - base + 1] += angle_histogram(h, w, h2, w2, bins, alone and i == j)
        t, b = np.nonzero(sums)
        return pd.DataFrame({"t_idx": t + base, "pix": int(k["pix"]), "bin": b, "w": sums[t, b]})

    parts = placed.groupBy("pix", "s1", "b1", "s2", "b2").applyInPandas(histogram, "t_idx int, pix long, bin long, w double")
    # at most `bins` rows a pixel
    binned = parts.groupBy("t_idx", "pix", "bin").agg(F.sum("w").alias("w"))
    p = F.col("w") / F.sum("w").over(Window.partitionBy("t_idx", "pix"))
    return binned.withColumn("p", p).groupBy("t_idx", "pix").agg((-F.sum(F.col("p") * F.log("p")) / math.log(bins)).alias("entropy"))


def diffusivity(steps: DataFrame, group=("pix",), axes=("vx", "vy", "vz")) -> DataFrame:
    """Covariance-based estimate per group: ``diffusion = (var + 2 cov) / (2 mean dt)`` and ``noise = max(-cov, 0)``.

    Displacements are velocity times dt; ``var`` is about the group's mean and ``cov`` over consecutive rows of one track,
    both averaged over the axes. The means are partial sums joined back, so a group that holds most rows is no single
    task. Steps with a null velocity or dt count in ``n`` alone; a group of one row has no ``cov`` and so a null diffusion.
    """
    d = steps.withColumns({f"__d{a}": F.col(a) * F.col("dt") for a in axes})
    mean = d.groupBy(*group).agg(*(F.avg(f"__d{a}").alias(f"__m{a}") for a in axes))
    along = Window.partitionBy(*group, "track_id").orderBy("t")
    d = d.join(mean, list(group)).withColumns({f"__c{a}": F.col(f"__d{a}") - F.col(f"__m{a}") for a in axes})
    d = d.withColumns({f"__l{a}": F.col(f"__c{a}") * F.lag(f"__c{a}").over(along) for a in axes})
    var = sum((F.avg(F.col(f"__c{a}") ** 2) for a in axes), F.lit(0.0)) / len(axes)
    cov = sum((F.avg(f"__l{a}") for a in axes), F.lit(0.0)) / len(axes)
    out = d.groupBy(*group).agg(var.alias("var"), cov.alias("cov"), F.avg("dt").alias("mean_dt"), F.count("*").alias("n"))
    return out.select(*group, "n", ((F.col("var") + 2 * F.col("cov")) / (2 * F.col("mean_dt"))).alias("diffusion"), F.greatest(-F.col("cov"), F.lit(0.0)).alias("noise"))


def residual_steps(steps: DataFrame, field: DataFrame, nside: int, radius: float) -> DataFrame:
    """Steps with their pixel's fitted tangent velocity taken off: ``vu, vv`` residuals. Needs one window's field."""
    rows = tangent_coordinates(on_pixels(steps, nside), radius).join(field.select("pix", "drift_u", "drift_v", "j00", "j01", "j10", "j11"), "pix")
    return rows.withColumns({
        "vu": F.col("vu") - F.col("drift_u") - F.col("j00") * F.col("u") - F.col("j01") * F.col("v"),
        "vv": F.col("vv") - F.col("drift_v") - F.col("j10") * F.col("u") - F.col("j11") * F.col("v"),
    })


def flux(field: DataFrame, nside: int, radius: float = 1.0) -> DataFrame:
    """Net flux (divergence times pixel area) and throughput (drift speed times the root of the area)."""
    area = pixel_area(nside, radius)
    return field.withColumns({"net_flux": F.col("divergence") * area, "throughput": F.col("drift_speed") * math.sqrt(area)})


def qc_masks(counts: DataFrame, limits=None) -> DataFrame:
    """One flag per limit on the count: fields are trusted where enough rows stand behind them."""
    limits = limits or {"ok_density": 8, "ok_vector": 50, "ok_metrics": 100, "ok_materials": 150}
    return counts.withColumns({name: F.col("n") >= least for name, least in limits.items()})


def density_entropy(counts: DataFrame, time: str = "t") -> DataFrame:
    """Per frame: entropy of the pixel shares, and the squared difference of the shares from the frame before."""
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(time)))
    own = p.groupBy(time).agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-16))).alias("entropy"))
    both = p.select(time, "pix", "p").unionByName(p.select((F.col(time) + 1).alias(time), "pix", (-F.col("p")).alias("p")))
    diff = both.groupBy(time, "pix").agg(F.sum("p").alias("d")).groupBy(time).agg(F.sum(F.col("d") ** 2).alias("change"))
    before = own.select((F.col(time) + 1).alias(time)).withColumn("has", F.lit(True))
    out = own.join(diff, time, "left").join(before, time, "left")
    return out.select(time, "entropy", F.when(F.col("has"), F.col("change")).alias("change"))


def dipole(units: DataFrame, value: str, frame: str = "t") -> DataFrame:
    """Length of the sum of ``(value - mean) * direction`` per frame, and the same after dealing the values out anew by the
    order of the MD5 of the track ids, as a null."""
    mean = F.avg(value).over(Window.partitionBy(frame))
    base = units.select(frame, "track_id", "ux", "uy", "uz", (F.col(value) - mean).alias("f"))
    ranked = base.withColumns({
        "i": F.row_number().over(Window.partitionBy(frame).orderBy("track_id")), "j": F.row_number().over(Window.partitionBy(frame).orderBy(F.md5(F.col("track_id").cast("string")), "track_id")),
    })
    dealt = ranked.join(ranked.select(frame, F.col("j").alias("i"), F.col("f").alias("g")), [frame, "i"])
    sums = dealt.groupBy(frame).agg(*(F.sum(F.col(v) * F.col(f"u{a}")).alias(f"{v}{a}") for v in "fg" for a in "xyz"))
    return sums.select(frame, *(F.sqrt(sum((F.col(f"{v}{a}") ** 2 for a in "xyz"), F.lit(0.0))).alias(n) for v, n in (("f", "dipole"), ("g", "dipole_null"))))


def top_pixels(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` densest pixels with weights that sum to one (equal where all are zero)."""
    top = counts.orderBy(F.desc("n"), "pix").limit(k)
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("weight", F.when(total > 0, F.col("n") / total).otherwise(1.0 / F.count("*").over(Window.partitionBy(F.lit(1)))))


def smooth_field(field: DataFrame, nside: int, sigma: float, value: str = "value", keys=("t",), k: int = 25) -> DataFrame:
    """Gaussian mean over those of the ``k`` nearest pixels within three sigmas that hold a value.

    Pixels equally far to six digits are taken by number, as symmetric ones differ in the last bits only.
    """
    near = pixel_neighbors(field.sparkSession, nside, 3 * sigma)
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("pix").orderBy(F.round("angle", 6), "near"))).where(F.col("r") <= k)
    table = ranked.select("pix", F.col("near").alias("src"), F.exp(-0.5 * (F.col("angle") / sigma) ** 2).alias("w"))
    rows = field.select(*keys, F.col("pix").alias("src"), F.col(value).alias("v")).where("v IS NOT NULL").join(small_broadcast(table, k * npix(nside)), "src")
    return rows.groupBy(*keys, "pix").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias(f"{value}_smooth"))


def laplacian_smooth(field: DataFrame, nside: int, tau: float = 0.5, rounds: int = 10, value: str = "value", keys=("t",)) -> DataFrame:
    """Solves ``(I + tau L) f = value`` over adjacent pixels by Jacobi rounds; absent pixels take no part."""
    reach = 1.5 * math.sqrt(4 * math.pi / npix(nside))
    near = materialize(pixel_neighbors(field.sparkSession, nside, reach).where("pix <> near"), "near")
    edges = small_broadcast(near.select(F.col("pix"), F.col("near").alias("src")), neighbor_rows(nside, reach))
    base = materialize(field.select(*keys, "pix", F.col(value).alias("b")), "jacobi")
    cur = base.withColumn("f", F.col("b"))
    for _ in range(rounds):
        got = cur.select(*keys, F.col("pix").alias("src"), "f").join(edges, "src").groupBy(*keys, "pix").agg(F.sum("f").alias("s"), F.count("*").alias("d"))
        nxt = base.join(got, [*keys, "pix"], "left")
        cur = materialize(nxt.select(*keys, "pix", "b", ((F.col("b") + tau * F.coalesce("s", F.lit(0.0))) / (1 + tau * F.coalesce("d", F.lit(0)))).alias("f")), "jacobi")
    return cur.select(*keys, "pix", F.col("f").alias(f"{value}_smooth"))


def sample_field(points: DataFrame, field: DataFrame, nside: int, keys=("t",)) -> DataFrame:
    """Field values at the points' pixels."""
    return with_pixel(points, nside).join(field, [*keys, "pix"], "left")


def pixel_msd(steps: DataFrame, nside: int, lags=(1, 2, 4)) -> DataFrame:
    """``pix, lag, msd, n`` over rows of one track that stay in a pixel for ``lag`` consecutive rows."""
    rows = with_pixel(steps.select("track_id", "t", "mx", "my", "mz", "theta", "phi"), nside)
    along = Window.partitionBy("track_id").orderBy("t")
    rows = rows.withColumn("i", F.row_number().over(along)).withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("track_id", "pix").orderBy("t")))
    early = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("j", F.col("i") + F.col("lag"))
    late = rows.select("track_id", "pix", "run", F.col("i").alias("j"), *(F.col(f"m{a}").alias(f"q{a}") for a in "xyz"))
    d2 = sum(((F.col(f"q{a}") - F.col(f"m{a}")) ** 2 for a in "xyz"), F.lit(0.0))
    return early.join(late, ["track_id", "pix", "run", "j"]).groupBy("pix", "lag").agg(F.avg(d2).alias("msd"), F.count("*").alias("n"))


def pixel_msd_exponent(points: DataFrame, nside: int, window: float, stride: float, lags=(1, 2, 4), time: str = "time_min") -> DataFrame:
    """``t_idx, pix, msd_value, msd_alpha`` from pairs of rows of one track, ``lag`` rows apart and in one pixel all the while,
    with both ends in the window.

    ``msd_alpha`` is the slope of log MSD over log mean time difference (two lags at least), ``msd_value`` the MSD of the
    longest lag with a positive one. Rows with equal times give no pair.
    """
    rows = with_pixel(points.select("track_id", time, "x", "y", "z", "theta", "phi"), nside)
    along = Window.partitionBy("track_id").orderBy(time)
    rows = rows.withColumn("i", F.row_number().over(along)).withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy("track_id", "pix").orderBy(time)))
    rows = with_panes(rows, time, window, stride)
    early = rows.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("j", F.col("i") + F.col("lag"))
    late = rows.select("track_id", "pix", "run", F.col("i").alias("j"), F.col(time).alias("__end"), F.col("w_lo").alias("n_lo"), F.col("w_hi").alias("n_hi"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    d2 = sum(((F.col(f"q{a}") - F.col(a)) ** 2 for a in "xyz"), F.lit(0.0))
    pairs = early.join(late, ["track_id", "pix", "run", "j"]).where(F.col("__end") > F.col(time))
    pairs = pairs.select("pix", "lag", F.greatest("w_lo", "n_lo").alias("w_lo"), F.least("w_hi", "n_hi").alias("w_hi"), d2.alias("d2"), (F.col("__end") - F.col(time)).alias("dt")).where("w_lo <= w_hi")
    sums = by_window(pairs, ["pix", "lag"], {"d2": F.col("d2"), "dt": F.col("dt"), "n": F.lit(1).cast("long")})
    per = sums.select("t_idx", "pix", "lag", (F.col("d2") / F.col("n")).alias("msd"), (F.col("dt") / F.col("n")).alias("tau")).where("msd > 0")
    slope = F.regr_slope(F.log("msd"), F.log("tau"))
    return per.groupBy("t_idx", "pix").agg(F.max_by("msd", "lag").alias("msd_value"), F.when(F.count("*") > 1, slope).alias("msd_alpha"))
