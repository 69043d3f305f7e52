"""Labelled voxels: region features, quality filters, overlaps. Voxels have ``t, z, y, x, channel, label, intensity``."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitrace.session import materialize, tasks_for

VOXEL = ("t", "z", "y", "x")
#: Labels of a frame that meet first in the search for shadows, the most cuts of a frame, and voxel pairs held at a time.
TILE, TILES, PAIRS = 500, 1000, 2_000_000


def foreground(voxels: DataFrame) -> DataFrame:
    return voxels.where("label > 0")


def mean_intensity(voxels: DataFrame) -> DataFrame:
    """``t, label, channel, mean_fluo`` of the foreground."""
    return foreground(voxels).groupBy("t", "label", "channel").agg(F.avg("intensity").alias("mean_fluo"))


def with_eigenvalues(df: DataFrame, names=("eig_a", "eig_b", "eig_c")) -> DataFrame:
    """Eigenvalues, largest first, of the symmetric matrix of ``vx, vy, vz, cxy, cxz, cyz``, in closed form and in steps."""
    c = lambda k: F.col("__g_" + k)
    out = df.withColumn("__g_q", (F.col("vx") + F.col("vy") + F.col("vz")) / 3)
    off = F.col("cxy") ** 2 + F.col("cxz") ** 2 + F.col("cyz") ** 2
    out = out.withColumn("__g_p", F.sqrt((sum(((F.col(f"v{a}") - c("q")) ** 2 for a in "xyz"), F.lit(0.0)) + 2 * off) / 6))
    out = out.withColumns({f"__g_{a}": (F.col(f"v{a}") - c("q")) / c("p") for a in "xyz"} | {f"__g_{k}": F.col(f"c{k}") / c("p") for k in ("xy", "xz", "yz")})
    half = (c("x") * (c("y") * c("z") - c("yz") ** 2) - c("xy") * (c("xy") * c("z") - c("yz") * c("xz")) + c("xz") * (c("xy") * c("yz") - c("y") * c("xz"))) / 2
    out = out.withColumn("__g_phi", F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0))) / 3)
    out = out.withColumns({"__g_hi": c("q") + 2 * c("p") * F.cos("__g_phi"), "__g_lo": c("q") + 2 * c("p") * F.cos(c("phi") + 2 * math.pi / 3)})
    flat = c("p") <= 1e-12
    values = (c("hi"), 3 * c("q") - c("hi") - c("lo"), c("lo"))
    made = F.struct(*(F.when(flat, c("q")).otherwise(v).alias(n) for n, v in zip(names, values, strict=True)))
    # a filter on the values stays above a generator; pushed below, it would repeat every step
    return out.select(*df.columns, F.explode(F.array(made)).alias("__g")).select(*df.columns, *(f"__g.{n}" for n in names))


def region_features(voxels: DataFrame) -> DataFrame:
    """Per frame and label: volume, bounding box, extent, centroid, intensities and ``elongation`` (largest over smallest axis
    length of the covariance, null where flat). All from one aggregation."""
    agg = foreground(voxels).groupBy("t", "label").agg(
        F.count("*").alias("volume"), *(F.avg(a).alias(f"c{a}") for a in "zyx"), *((F.max(a) - F.min(a) + 1).alias(f"bbox_{a}") for a in "zyx"),
        F.avg("intensity").alias("mean_intensity"), F.min("intensity").alias("min_intensity"), F.max("intensity").alias("max_intensity"),
        *(F.var_pop(a).alias(f"v{a}") for a in "zyx"), F.covar_pop("x", "y").alias("cxy"), F.covar_pop("x", "z").alias("cxz"), F.covar_pop("y", "z").alias("cyz"),
    )
    out = with_eigenvalues(agg).withColumn("extent", F.col("volume") / (F.col("bbox_z") * F.col("bbox_y") * F.col("bbox_x")))
    out = out.withColumn("elongation", F.when(F.col("eig_c") > 1e-9, F.sqrt(F.col("eig_a") / F.col("eig_c"))))
    return out.drop("eig_a", "eig_b", "eig_c", "vx", "vy", "vz", "cxy", "cxz", "cyz")


def volume_filter(voxels: DataFrame, least: float, voxel_volume: float = 1.0) -> DataFrame:
    """``t, label, volume`` of the labels over ``least``."""
    return foreground(voxels).groupBy("t", "label").agg((F.count("*") * voxel_volume).alias("volume")).where(F.col("volume") > least)


def shape_filter(voxels: DataFrame, most: float = 2.0, least_axis: float = 2.0) -> DataFrame:
    """Semi-axes ``a >= b >= c`` (the roots of five times the eigenvalues), eccentricity ``a / (b + 1e-4)``, and the labels
    with at most ``most`` of it and ``b`` of at least ``least_axis``."""
    s = foreground(voxels).groupBy("t", "label").agg(
        *(F.var_pop(a).alias(f"v{a}") for a in "zyx"), F.covar_pop("x", "y").alias("cxy"), F.covar_pop("x", "z").alias("cxz"), F.covar_pop("y", "z").alias("cyz")
    )
    e = with_eigenvalues(s)
    out = e.select("t", "label", *(F.sqrt(5 * F.greatest(F.col(f"eig_{k}"), F.lit(0.0))).alias(f"axis_{k}") for k in "abc"))
    out = out.withColumn("eccentricity", F.col("axis_a") / (F.col("axis_b") + 1e-4))
    return out.where((F.col("eccentricity") <= most) & (F.col("axis_b") >= least_axis))


def shadowed_labels(voxels: DataFrame, overlap: float = 0.5, z_scale: float = 1.0, z_low: float = -30.0) -> DataFrame:
    """``t, label`` of the labels that lie below another one: the shared XY area is at least ``overlap`` of the label's and
    the scaled difference of mean z is from ``z_low`` up to 0.

    A label that is itself shadowed still casts a shadow. One shadow settles a label, so labels meet in tiles of about
    ``TILE`` labels of near depth first, then with the tile below, and only those without a shadow by then meet all others of
    their frame, by pixel. Where few labels are shadowed, that last join is of all labels that share a pixel.
    """
    flat = materialize(foreground(voxels).select("t", "label", "y", "x").distinct(), "flat")
    area = flat.groupBy("t", "label").agg(F.count("*").alias("area"))
    depth = foreground(voxels).groupBy("t", "label").agg(F.avg("z").alias("cz"))
    info = materialize(area.join(depth, ["t", "label"]), "labels")
    # cuts of depth by frame; where they lie only decides who meets first
    tiles = info.groupBy("t").agg(F.count("*").alias("n"), F.percentile_approx("cz", F.array(*(F.lit(i / TILES) for i in range(1, TILES))), F.lit(10_000)).alias("cuts"))
    every = F.ceil(F.lit(1.0) * TILE * TILES / F.col("n")).cast("int")
    tiles = tiles.withColumn("every", every).withColumn("cuts", F.filter("cuts", lambda c, i: (i + 1) % F.col("every") == 0))
    place = info.join(F.broadcast(tiles), "t")  # one row a frame
    place = place.withColumn("tile", F.size(F.filter("cuts", lambda c: c < F.col("cz")))).select("t", "label", "area", "cz", "tile")
    place = materialize(place, "tiles")
    columns = ["t", "tile", "label", "y", "x", "area", "cz"]
    kinds = dict(place.dtypes)
    schema = f"t {kinds['t']}, label {kinds['label']}"
    rows = flat.where("y IS NOT NULL AND x IS NOT NULL").join(place, ["t", "label"]).select(*columns)
    # a tile is much work for few bytes, so small partitions are not put together
    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumns({"asks": F.lit(True), "casts": F.lit(True)})
    first = materialize(both.repartition(parts, "t", "tile").groupBy("t", "tile").applyInArrow(_cast_shadows(overlap, z_scale, z_low), schema), "shadowed")
    rest = materialize(place.join(first, ["t", "label"], "left_anti"), "open")
    asks = rows.join(rest, ["t", "label"], "left_semi").select(*columns, F.lit(True).alias("asks"), F.lit(False).alias("casts"))
    below = rows.withColumns({"tile": F.col("tile") + 1, "asks": F.lit(False), "casts": F.lit(True)})
    below = below.join(rest.select("t", "tile").distinct(), ["t", "tile"], "left_semi")
    second = asks.unionByName(below).repartition(parts, "t", "tile").groupBy("t", "tile").applyInArrow(_cast_shadows(overlap, z_scale, z_low), schema)
    second = materialize(second, "shadowed")
    rest = rest.join(second, ["t", "label"], "left_anti")
    # the others in full, by pixel
    mine = flat.join(rest.select("t", "label"), ["t", "label"])
    meet = mine.join(flat.select("t", "y", "x", F.col("label").alias("other")), ["t", "y", "x"]).where("label <> other")
    shared = meet.groupBy("t", "label", "other").agg(F.count("*").alias("n"))
    o = info.select("t", F.col("label").alias("other"), F.col("cz").alias("oz"))
    dz = (F.col("oz") - F.col("cz")) * z_scale
    hit = shared.join(rest, ["t", "label"]).join(o, ["t", "other"]).where((F.col("n") / F.col("area") >= overlap) & (dz < 0) & (dz >= z_low))
    return first.unionByName(second).unionByName(hit.select("t", "label").distinct())


def _cast_shadows(overlap: float, z_scale: float, z_low: float):
    """The labels of a tile that ask and lie below one that casts; voxels are paired by pixel, ``PAIRS`` at a time."""

    def run(table: pa.Table) -> pa.Table:
        col = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        labels, first, code = np.unique(col("label"), return_index=True, return_inverse=True)
        area, cz = col("area")[first], col("cz")[first]
        _, y = np.unique(col("y"), return_inverse=True)
        _, x = np.unique(col("x"), return_inverse=True)
        pixel = y.astype(np.int64) * (int(x.max(initial=0)) + 1) + x
        asks, casts = col("asks").astype(bool), col("casts").astype(bool)
        order = np.argsort(pixel[casts], kind="stable")
        where, who = pixel[casts][order], code[casts][order]
        mine, at = code[asks], pixel[asks]
        begin, end = np.searchsorted(where, at, "left"), np.searchsorted(where, at, "right")
        order = np.argsort(mine, kind="stable")
        mine, begin, many = mine[order], begin[order], (end - begin)[order]
        # whole labels at a time
        edges = np.flatnonzero(np.append(True, np.diff(mine) != 0)) if len(mine) else np.zeros(0, int)
        edges = np.append(edges, len(mine))
        total = np.append(0, np.cumsum(many))
        found, i = [], 0
        while i < len(edges) - 1:
            j = i + 1
            while j < len(edges) - 1 and total[edges[j + 1]] - total[edges[i]] <= PAIRS:
                j += 1
            a, b = edges[i], edges[j]
            n = many[a:b]
            step = np.arange(total[b] - total[a]) - np.repeat(total[a:b] - total[a], n)
            left, right = np.repeat(mine[a:b], n), who[np.repeat(begin[a:b], n) + step]
            pair, count = np.unique(left * len(labels) + right, return_counts=True)
            left, right = pair // len(labels), pair % len(labels)
            dz = (cz[right] - cz[left]) * z_scale
            found.append(np.unique(left[(left != right) & (count / area[left] >= overlap) & (dz < 0) & (dz >= z_low)]))
            i = j
        got = first[np.concatenate(found)] if found else np.zeros(0, np.int64)
        return table.select(["t", "label"]).take(pa.array(got))

    return run


def mask_quality(voxels: DataFrame, least_volume: float | None = 5, overlap: float | None = 0.5, eccentricity: float | None = None, surface: float | None = None) -> DataFrame:
    """Labels that pass the chosen filters in turn (None skips one), numbered 1.. within their frame.

    The filters are volume, shadows, shape, and the distance of the centroid from the inner radius of the sphere that is
    fitted to the frame's centroids.
    """
    kept = foreground(voxels).select("t", "label").distinct()
    rest = voxels
    if least_volume is not None:
        kept = volume_filter(rest, least_volume).select("t", "label")
        rest = rest.join(kept, ["t", "label"], "left_semi")
    if overlap is not None:
        kept = kept.join(shadowed_labels(rest, overlap), ["t", "label"], "left_anti")
        rest = rest.join(kept, ["t", "label"], "left_semi")
    if eccentricity is not None:
        kept = kept.join(shape_filter(rest, eccentricity), ["t", "label"], "left_semi")
        rest = rest.join(kept, ["t", "label"], "left_semi")
    if surface is not None:
        from orbitrace.operators.surface import surface_distance_filter

        centers = foreground(rest).groupBy("t", "label").agg(*(F.avg(a).alias(a) for a in "zyx"))
        kept = kept.join(surface_distance_filter(centers, surface), ["t", "label"], "left_semi")
    return kept.withColumn("new_label", F.dense_rank().over(Window.partitionBy("t").orderBy("label")))


def max_projection(voxels: DataFrame, axis: str = "z", middle: float | None = None) -> DataFrame:
    """Largest intensity along an axis, by half where ``middle`` is given."""
    keep = ["t", "channel", *(a for a in "zyx" if a != axis)]
    if middle is None:
        return voxels.groupBy(*keep).agg(F.max("intensity").alias("intensity"))
    side = F.when(F.col(axis) < middle, "front").otherwise("back").alias("half")
    return voxels.groupBy(*keep, side).agg(F.max("intensity").alias("intensity"))


def dominant_label(rows: DataFrame, group, label: str = "label") -> DataFrame:
    """Most common label per group; of equally common ones the smallest."""
    n = rows.groupBy(*group, label).agg(F.count("*").alias("n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("label"))).alias("b")).select(*group, F.col("b.label").alias(label))


def transfer_fluorescence(target: DataFrame, source: DataFrame, values: DataFrame) -> DataFrame:
    """``label, fluo``: mean of the source labels' values weighted by the voxels they share with a target label.

    The source labels of a voxel are summed before they meet the target's, so no pair of labels becomes a row.
    """
    keys = ["t", "z", "y", "x"]
    parts = tasks_for(target.count() + source.count(), target)
    held = source.select(*keys, "label").repartition(parts, *keys).distinct().join(values.select("label", F.col("mean_fluo").alias("v")), "label")
    # a null value still counts as a voxel
    held = held.groupBy(*keys).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    mine = target.select(*keys, "label").repartition(parts, *keys).distinct().join(held.hint("merge"), keys)
    return mine.groupBy("label").agg((F.sum("v") / F.sum("n")).alias("fluo"))


def brightest_uncovered(bright: DataFrame, masks: DataFrame, values: DataFrame, n: int, most: float) -> DataFrame:
    """The ``n`` brightest mask labels of which at most a share ``most`` of the voxels lies under bright labels.

    The bright labels of a voxel are counted before they meet the masks, so no pair of labels becomes a row.
    """
    keys = ["t", "z", "y", "x"]
    parts = tasks_for(masks.count(), masks)
    mine = masks.select(*keys, "label").repartition(parts, *keys).distinct()
    held = bright.select(*keys, "label").repartition(parts, *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    both = mine.join(held.hint("merge"), keys, "left").groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("size"))
    covered = both.where(F.col("n") / F.col("size") > most)
    return values.join(covered, "label", "left_anti").orderBy(F.desc("mean_fluo"), "label").limit(n)


def dropped_labels(tracked: DataFrame, masks: DataFrame, most: float = 0.1, max_id: int | None = None) -> DataFrame:
    """Mask labels of which less than ``most`` of the voxels lie under tracked labels, with new ids above the largest one."""
    keys = ["t", "z", "y", "x"]
    m = masks.select(*keys, "label").distinct()
    under = m.join(tracked.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    share = under.groupBy("t", "label").agg((F.count("hit") / F.count("*")).alias("share")).where(F.col("share") < most)
    top = F.broadcast(tracked.agg(F.max("label").alias("__top")))  # one row
    order = F.row_number().over(Window.partitionBy("t").orderBy("label"))
    per = share.groupBy("t").agg(F.count("*").alias("n"))
    base = per.select("t", F.coalesce(F.sum("n").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row a frame
    out = share.withColumn("__r", order).join(F.broadcast(base), "t").join(top)
    return out.select("t", "label", "share", (F.coalesce("__top", F.lit(0)) + F.col("__b") + F.col("__r")).alias("track_id"))


def matched_share(pairs: DataFrame, flag: str) -> DataFrame:
    return pairs.agg(F.avg(F.col(flag).cast("double")).alias("share"))
