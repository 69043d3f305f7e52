"""Material response of a tissue: cage-relative motion and non-affine displacement, by moment sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrace.operators.blocks import points
from orbitrace.operators.neighbors import nearest
from orbitrace.operators.tracks import AXES
from orbitrace.session import materialize

#: Local fits that are made at a time.
FIT_ROWS = 64


def _with_ends(tracks: DataFrame, lags) -> DataFrame:
    """``track_id, t, x, y, z`` and the places ``e<lag><axis>`` of the track ``lag`` frames later, null where it is not there."""
    slim = materialize(tracks.select("track_id", "t", *AXES), "tracks")
    out = slim
    for lag in lags:
        end = slim.select("track_id", (F.col("t") - lag).alias("t"), *(F.col(a).alias(f"e{lag}{a}") for a in AXES))
        out = out.join(end, ["track_id", "t"], "left")
    return out


def cage_relative_msd(tracks: DataFrame, k: int, radius: float, lags=(1, 2, 4), least: int = 3) -> DataFrame:
    """``lag, msd, n``: squared displacement of a cell after the mean displacement of its ``k`` nearest cells is taken off.

    Neighbours are those at the start; cells with fewer than ``least`` neighbours that are still there are left out. A cell goes
    to its neighbours with its later places, and one squared displacement a lag is what leaves a task.
    """
    ends = [[f"e{lag}{a}" for a in AXES] for lag in lags]

    def fold(mine, near):
        own, other = points(mine, AXES), points(near, AXES)
        moves = [(points(mine, e) - own, points(near, e) - other) for e in ends]

        def squares(rows, picked):
            for moved, around in moves:
                there = (picked >= 0) & ~np.isnan(around[picked]).any(axis=2)
                n = there.sum(axis=1)
                cage = np.where(there[..., None], around[picked], 0.0).sum(axis=1) / np.maximum(n, 1)[:, None]
                yield np.where(n >= least, ((moved[rows] - cage) ** 2).sum(axis=1), np.nan)

        return squares

    slim = materialize(_with_ends(tracks, lags), "ends")
    near = nearest(slim, slim, k, radius, "track_id", include_self=False, carry=[c for e in ends for c in e], fold=([f"d{lag}" for lag in lags], fold))
    each = near.select(F.explode(F.array(*(F.struct(F.lit(lag).alias("lag"), F.col(f"d{lag}").alias("d2")) for lag in lags))).alias("x")).select("x.*")
    return each.where("d2 IS NOT NULL").groupBy("lag").agg(F.avg("d2").alias("msd"), F.count("*").alias("n"))


#: Sums over a cell's neighbours: their number, sums of b.b, a a^T and a b^T, and the mean displacement.
CAGE = ["n", "bb", *(f"g{q}{r}" for i, q in enumerate(AXES) for r in AXES[i:]), *(f"m{q}{r}" for q in AXES for r in AXES), *(f"c{a}" for a in AXES)]


def _cage_sums(ends: list[str]):
    """The columns ``CAGE`` as a fold of nearest rows, with offsets ``a`` at the start and ``b`` at the places ``ends``.

    Neighbours without a place there, and all of a cell without one, are left out.
    """

    def fold(mine, near):
        own, other, own_end, other_end = points(mine, AXES), points(near, AXES), points(mine, ends), points(near, ends)

        def sums(rows, picked):
            there = (picked >= 0) & ~np.isnan(other_end[picked]).any(axis=2) & ~np.isnan(own_end[rows]).any(axis=1)[:, None]
            n, kept = there.sum(axis=1), there[..., None]
            a = np.where(kept, other[picked] - own[rows, None], 0.0)
            b = np.where(kept, other_end[picked] - own_end[rows, None], 0.0)
            moved = np.where(kept, other_end[picked] - other[picked], 0.0).sum(axis=1) / np.maximum(n, 1)[:, None]
            g, m = np.einsum("nki,nkj->nij", a, a), np.einsum("nki,nkj->nij", a, b)
            return [n, (b * b).sum(axis=(1, 2)), *(g[:, i, j] for i in range(3) for j in range(i, 3)), *(m[:, i, j] for i in range(3) for j in range(3)), *moved.T]

        return sums

    return CAGE, fold


def _cage_motion(ends: list[str], least: int, keep: list[str]):
    """The columns ``keep``, the squared displacement about the cage's mean ``rel`` and ``d2min`` as a fold of nearest rows."""
    names, sums = _cage_sums(ends)
    upper = {tuple(sorted(c[1:])): i for i, c in enumerate(names) if c[0] == "g"}

    def fold(mine, near):
        summed, moved, kept = sums(mine, near), points(mine, ends) - points(mine, AXES), points(mine, keep)

        def each(rows, picked):
            c = summed(rows, picked)
            n = c[0]
            g = np.stack([c[upper[tuple(sorted((q, r)))]] for q in AXES for r in AXES], axis=1).reshape(-1, 3, 3)
            m = np.stack([c[i] for i, name in enumerate(names) if name[0] == "m"], axis=1).reshape(-1, 3, 3)
            rel = ((moved[rows] - np.stack(c[-3:], axis=1)) ** 2).sum(axis=1)
            return [*kept[rows].T, np.where(n > 0, rel, np.nan), _best_map(g, m, c[1], n, least)]

        return each

    return [*keep, "rel", "d2min"], fold


def d2min(tracks: DataFrame, k: int, radius: float, lag: int = 1, least: int = 4) -> DataFrame:
    """``track_id, t, d2min``: mean squared part of the neighbours' relative motion that no affine map explains.

    With neighbour offsets ``a`` and later offsets ``b``, the best map has the residual
    ``(sum b.b - trace(B^T G^-1 B)) / n`` for ``G = sum a a^T`` and ``B = sum a b^T``: these sums leave the task that finds the
    neighbours, one row a cell, and a closed 3 by 3 inverse follows. A flat neighbourhood (singular G) or fewer than ``least``
    neighbours gives null.
    """
    ends = [f"e{lag}{a}" for a in AXES]
    slim = materialize(_with_ends(tracks, [lag]), "ends")
    sums = nearest(slim, slim, k, radius, "track_id", include_self=False, carry=ends, fold=_cage_sums(ends))
    return _residual(sums.where("n > 0"), ["track_id", "t"], least).select("track_id", "t", "d2min")


def _residual(s: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``keys``, the sums ``CAGE`` and ``d2min`` from them; a flat neighbourhood gives null. ``s`` has the sums, or a row for each
    neighbour with its offsets ``a*`` and later offsets ``b*``, which are summed first."""
    if "n" not in s.columns:
        products = {f"g{q}{r}": F.col(f"a{q}") * F.col(f"a{r}") for i, q in enumerate(AXES) for r in AXES[i:]} | {f"m{q}{r}": F.col(f"a{q}") * F.col(f"b{r}") for q in AXES for r in AXES}
        products |= {"bb": sum((F.col(f"b{a}") ** 2 for a in AXES), F.lit(0.0))}
        s = s.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in products.items()))
    kept = s.columns
    g = lambda q, r: F.col("g" + "".join(sorted((q, r))))
    cof = {}
    for i, q in enumerate(AXES):
        for j, r in enumerate(AXES):
            q1, q2, r1, r2 = AXES[(i + 1) % 3], AXES[(i + 2) % 3], AXES[(j + 1) % 3], AXES[(j + 2) % 3]
            cof[q, r] = g(q1, r1) * g(q2, r2) - g(q1, r2) * g(q2, r1)
    s = s.withColumns({f"k{q}{r}": c for (q, r), c in cof.items()})
    s = s.withColumn("det", sum((g("x", r) * F.col(f"kx{r}") for r in AXES), F.lit(0.0)))
    explained = sum((F.col(f"m{q}{c}") * F.col(f"k{q}{r}") * F.col(f"m{r}{c}") for q in AXES for r in AXES for c in AXES), F.lit(0.0)) / F.col("det")
    good = (F.col("n") >= least) & (F.abs("det") > 1e-9 * g("x", "x") * g("y", "y") * g("z", "z"))
    return s.select(*kept, F.when(good, F.greatest(F.col("bb") - explained, F.lit(0.0)) / F.col("n")).alias("d2min"))


def _least_norm(g: np.ndarray, m: np.ndarray, bb: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Mean squared residuals after the maps of least norm, for sums ``g`` of a a^T, ``m`` of a b^T and ``bb`` of b.b over ``n``."""
    fit = np.linalg.pinv(g, rcond=1e-12, hermitian=True) @ m
    return np.maximum(bb - np.einsum("nij,nij->n", m, fit), 0) / n


def _best_map(g: np.ndarray, m: np.ndarray, bb: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """The same after the best maps, in closed form where ``g`` is regular, and NaN for under ``least`` neighbours."""
    cof = np.stack([np.cross(g[:, 1], g[:, 2]), np.cross(g[:, 2], g[:, 0]), np.cross(g[:, 0], g[:, 1])], axis=1)
    det = (g[:, 0] * cof[:, 0]).sum(axis=1)
    out = np.full(len(n), np.nan)
    good = (n >= least) & (np.abs(det) > 1e-9 * g[:, 0, 0] * g[:, 1, 1] * g[:, 2, 2])
    explained = np.einsum("nqc,nqr,nrc->n", m[good], cof[good], m[good]) / det[good]
    out[good] = np.maximum(bb[good] - explained, 0) / n[good]
    flat = (n >= least) & ~good
    if flat.any():
        out[flat] = _least_norm(g[flat], m[flat], bb[flat], n[flat])
    return out


def _flat_residual(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, d2min`` of neighbourhoods with a singular sum, by its pseudo-inverse (the map of least norm)."""
    import pandas as pd

    def solve(batches):
        for pdf in batches:
            g = np.array([[pdf["g" + "".join(sorted((q, r)))] for r in AXES] for q in AXES], dtype=float).transpose(2, 0, 1)
            m = np.array([[pdf[f"m{q}{r}"] for r in AXES] for q in AXES], dtype=float).transpose(2, 0, 1)
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "d2min": _least_norm(g, m, pdf["bb"].to_numpy(), pdf["n"].to_numpy())})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(solve, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "d2min double"]))


def material_fields(
    steps: DataFrame, nside: int, sigma: float, k: int = 10, window: float = 45.0, stride: float = 1.5, short: float = 3.0, long: float = 12.0, least: int = 3,
) -> DataFrame:
    """``t_idx, pix, cmsd_alpha, d2min_short, d2min_long`` of the steps within two sigmas of a pixel in a window, where there
    are at least three with a weight over 1e-2.

    The ``k`` nearest steps at the start are each step's cage. Steps of at most ``short`` median time differences are
    short, those of at least ``long`` are long. The exponent is that of the mean squared displacement about the cage's
    mean between the two; D2min is the weighted mean of the steps' residuals after the best affine map of the cage
    (``least`` neighbours at least; a flat cage takes the map of least norm). What has no such steps is null.
    """
    from orbitrace.functions.healpix import npix
    from orbitrace.operators.fields import spread_to_pixels
    from orbitrace.operators.stats import exact_quantiles

    middle = exact_quantiles(steps, "dt", [0.5])
    tau = [short * middle[0], long * middle[0]] if middle else [0.0, 0.0]
    # a cage is of the steps of one window, so here the windows are needed
    spread = spread_to_pixels(steps, nside, sigma, window, stride, 1e-2).withColumn("t_idx", F.explode(F.sequence("w_lo", "w_hi"))).withColumn("place", F.col("t_idx").cast("long") * npix(nside) + F.col("pix"))
    # a step is told by its track and frame
    ends = [f"e{a}" for a in AXES]
    rows = spread.select("place", F.struct("track_id", "t").alias("step"), "dt", "w", *(F.col(f"{a}0").alias(a) for a in AXES), *(F.col(a).alias(f"e{a}") for a in AXES))
    # what a step adds to its place leaves the block that finds its cage, so nothing is joined
    per = nearest(rows, rows, k, 50.0, "step", frame="place", include_self=False, carry=["dt", "w", *ends], fold=_cage_motion(ends, least, ["dt", "w"]))
    rel, mean = F.col("rel"), {}
    for name, mask in (("short", F.col("dt") <= tau[0]), ("long", F.col("dt") >= tau[1])):
        d = F.when(mask & F.col("d2min").isNotNull(), F.col("w"))
        mean[f"rel_{name}"], mean[f"d2min_{name}"] = F.avg(F.when(mask, rel)), F.sum(d * F.col("d2min")) / F.sum(d)
    out = per.groupBy("place").agg(F.count("*").alias("n"), *(c.alias(c_name) for c_name, c in mean.items())).where("n >= 3")
    good = (F.col("rel_short") > 0) & (F.col("rel_long") > 0) & F.lit(tau[1] > tau[0])
    slope = F.log(F.col("rel_long") / F.col("rel_short")) / math.log(long / short)
    return out.select(
        F.expr(f"CAST(place DIV {npix(nside)} AS INT)").alias("t_idx"), (F.col("place") % npix(nside)).alias("pix"), F.when(good, slope).alias("cmsd_alpha"), "d2min_short", "d2min_long"
    )


def lowess_threshold(series: DataFrame, group: str, order: str, value: str, share: float = 0.3, robust: int = 3) -> DataFrame:
    """Local linear trend per group: values up to a twentieth of the 95th percentile go, the rest are smoothed with tricube
    weights over the nearest ``share`` of them, and dropped places are filled linearly.

    ``robust`` more rounds weigh each value by the bisquare of its residual over six times the median one, so single
    wild values lose their pull. A group is a series with one value per time, so its size is the number of frames. The
    values are in order of time, so those that a fit looks at are a window that only moves on; fits are made
    ``FIT_ROWS`` at a time, and memory is that many windows. Null values are dropped places; a group of fewer than two
    values has a null trend; an empty table gives none.
    """
    import pandas as pd

    def fits(xs, ys, trust, start, n):
        """Local linear fits: fit i looks at the ``n`` values from ``start[i]`` on."""
        out = np.empty(len(xs))
        for a in range(0, len(xs), FIT_ROWS):
            at = start[a : a + FIT_ROWS, None] + np.arange(n)
            d = np.abs(xs[at] - xs[a : a + FIT_ROWS, None])
            h = np.maximum(d.max(axis=1, keepdims=True), 1e-12) * (1 + 1e-9)
            w = np.clip(1 - (d / h) ** 3, 0, None) ** 3 * trust[at]
            x, y = xs[at] - xs[a : a + FIT_ROWS, None], ys[at]
            total = np.maximum(w.sum(axis=1), 1e-300)
            m, mx = (w * y).sum(axis=1) / total, (w * x).sum(axis=1) / total
            sxx = (w * x**2).sum(axis=1) / total - mx**2
            slope = np.where(sxx > 1e-9, ((w * x * y).sum(axis=1) / total - mx * m) / np.where(sxx > 1e-9, sxx, 1.0), 0.0)
            out[a : a + FIT_ROWS] = m - slope * mx
        return out

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, y = pdf[order].to_numpy(float), pdf[value].to_numpy(float)
        good = np.isfinite(y) & (y > np.nanpercentile(y, 95) / 20) if np.isfinite(y).any() else np.zeros(len(y), bool)
        out = np.full(len(y), np.nan)
        if good.sum() >= 2:
            xs, ys, n = x[good], y[good], min(int(good.sum()), max(2, int(share * good.sum() + 1e-10)))
            # the window of the nearest values moves on while the next one is nearer than its first
            start, at = np.zeros(len(xs), np.int64), 0
            for i, v in enumerate(xs.tolist()):
                while at + n < len(xs) and xs[at + n] - v < v - xs[at]:
                    at += 1
                start[i] = at
            trust = np.ones(len(xs))
            for _ in range(robust + 1):
                fit = fits(xs, ys, trust, start, n)
                off = np.abs(ys - fit)
                scale = 6 * np.median(off)
                if scale <= 1e-9 * max(1.0, float(np.abs(ys).max())):
                    break
                trust = np.clip(1 - (off / scale) ** 2, 0, None) ** 2
            out = np.interp(x, xs, fit)
            for side, (i, j) in ((x < xs[0], (0, 1)), (x > xs[-1], (-2, -1))):
                out[side] = fit[i] + (fit[j] - fit[i]) / (xs[j] - xs[i]) * (x[side] - xs[i])
        return pd.DataFrame({group: pdf[group], order: pdf[order], "trend": out})

    kinds = dict(series.dtypes)
    return series.select(group, order, value).groupBy(group).applyInPandas(smooth, f"{group} {kinds[group]}, {order} {kinds[order]}, trend double")


def hex_counts(points: DataFrame, x: str, y: str, size: float, time: str = "t", half: int = 25) -> DataFrame:
    """Hexagonal bins ``hx, hy`` of width ``size``: points per bin and frame within ``half`` frames, per frame counted, and the
    mean over the bin and its six neighbours."""
    row = F.rint(F.col(y) / (size * 0.8660254037844386)).cast("long")
    shift = F.pmod(row, F.lit(2)) * 0.5
    binned = points.select(time, row.alias("hy"), F.rint(F.col(x) / size - shift).cast("long").alias("hx"))
    n = binned.groupBy(time, "hx", "hy").agg(F.count("*").alias("n"))
    wide = n.withColumn("c", F.explode(F.sequence(F.col(time) - half, F.col(time) + half)))
    times = points.select(time).distinct()
    spread = times.withColumn("c", F.explode(F.sequence(F.col(time) - half, F.col(time) + half))).groupBy("c").agg(F.count("*").alias("frames"))
    mean = wide.groupBy("c", "hx", "hy").agg(F.sum("n").alias("s")).join(spread, "c").join(times.select(F.col(time).alias("c")), "c")
    mean = mean.select(F.col("c").alias(time), "hx", "hy", (F.col("s") / F.col("frames")).alias("density"))
    odd = F.pmod(F.col("hy"), F.lit(2))
    around = F.array(*(F.struct(F.lit(dy).cast("long").alias("dy"), (F.lit(dx) if dy == 0 else F.lit(dx) + odd).cast("long").alias("dx")) for dy, dx in ((0, -1), (0, 0), (0, 1), (1, -1), (1, 0), (-1, -1), (-1, 0))))
    near = mean.withColumn("o", F.explode(around)).select(time, (F.col("hx") + F.col("o.dx")).alias("hx"), (F.col("hy") + F.col("o.dy")).alias("hy"), "density")
    smooth = near.groupBy(time, "hx", "hy").agg((F.sum("density") / 7).alias("smooth"))
    return mean.join(smooth, [time, "hx", "hy"])


def local_face_mean(vertices: DataFrame, faces: DataFrame, radius: float, value: str, key: str = "vertex_id") -> DataFrame:
    """Mean face value within ``radius`` of each vertex of its frame; null where there is none."""
    from orbitrace.operators.neighbors import radius_pairs

    near = radius_pairs(vertices.select(key, "t", *AXES), faces.select("t", *AXES, value), radius)
    per = near.groupBy(key, "t").agg(F.avg(f"n_{value}").alias(f"{value}_mean"), F.count("*").alias("n_faces"))
    return vertices.join(per, [key, "t"], "left")


def painted_vertices(patches: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Mean value per (t, track) painted on the vertices that belong to the track; vertices without a track get 0."""
    per = values.groupBy("t", "track_id").agg(F.avg(value).alias("__v"))
    return patches.join(per, ["t", "track_id"], "left").withColumn(value, F.coalesce("__v", F.lit(0.0))).drop("__v")


def border_vertices(faces: DataFrame, patches: DataFrame) -> DataFrame:
    """Vertices of the faces whose corners belong to more than one track. Faces have ``t, face_id, corners array``."""
    corners = faces.select("t", "face_id", F.explode("corners").alias("vertex_id")).join(patches.select("t", "vertex_id", "track_id"), ["t", "vertex_id"])
    mixed = corners.groupBy("t", "face_id").agg(F.countDistinct("track_id").alias("n")).where("n > 1").select("t", "face_id")
    return corners.join(mixed, ["t", "face_id"], "left_semi").select("t", "vertex_id").distinct()


def predict_age(train: DataFrame, test: DataFrame, features, age: str, seed: int = 7) -> DataFrame:
    """``test`` with ``age_linear`` and ``age_trees``: a linear model and boosted trees fitted on ``train``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    va = VectorAssembler(inputCols=list(features), outputCol="__x")
    x, out = va.transform(train), va.transform(test)
    out = LinearRegression(featuresCol="__x", labelCol=age, predictionCol="age_linear").fit(x).transform(out)
    out = GBTRegressor(featuresCol="__x", labelCol=age, predictionCol="age_trees", maxIter=10, seed=seed).fit(x).transform(out)
    return out.drop("__x")


def predict_class(train: DataFrame, test: DataFrame, features, label: str, hidden: int = 8, seed: int = 7) -> DataFrame:
    """``test`` with ``class_logistic`` and ``class_mlp``; labels are whole numbers from 0."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    va = VectorAssembler(inputCols=list(features), outputCol="__x")
    x, out = va.transform(train), va.transform(test)
    classes = int(train.agg(F.max(label).alias("m")).first().m) + 1
    extra = {"rawPredictionCol": "__r", "probabilityCol": "__p"}
    out = LogisticRegression(featuresCol="__x", labelCol=label, predictionCol="class_logistic", **extra).fit(x).transform(out).drop("__r", "__p")
    mlp = MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, predictionCol="class_mlp", layers=[len(features), hidden, classes], seed=seed, maxIter=50, **extra)
    return mlp.fit(x).transform(out).drop("__x", "__r", "__p")


def frame_share(tracks: DataFrame, other: DataFrame) -> DataFrame:
    """Share of the rows of ``tracks`` whose (track, frame) is in ``other`` too."""
    hit = other.select("track_id", "t").distinct().withColumn("hit", F.lit(1.0))
    return tracks.join(hit, ["track_id", "t"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("share"))

