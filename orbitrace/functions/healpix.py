"""HEALPix pixels in ring order.

A resolution has ``12 nside^2`` equal-area pixels on ``4 nside - 1`` rings: two polar caps and an equatorial belt.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HALF_PI = math.pi / 2


def npix(nside: int) -> int:
    return 12 * nside * nside


def pixel_area(nside: int, radius: float = 1.0) -> float:
    return 4 * math.pi * radius * radius / npix(nside)


def with_pixel(df: DataFrame, nside: int, theta: str = "theta", phi: str = "phi", name: str = "pix") -> DataFrame:
    """``df`` with the pixel of a direction; theta is clipped to [0, pi] and phi wrapped; null angles have no pixel.

    Worked out in steps, each in columns of its own, so that no expression repeats another.
    """
    n, t = nside, "__hp_"
    col = lambda k: F.col(t + k)
    whole = lambda c: F.floor(c).cast("bigint")
    out = df.withColumns({
        t + "z": F.cos(F.least(F.greatest(F.col(theta), F.lit(0.0)), F.lit(math.pi))),
        t + "tt": F.pmod(F.col(phi), F.lit(2 * math.pi)) / HALF_PI,
    })
    out = out.withColumns({
        t + "up": whole(n * (0.5 + col("tt")) - n * col("z") * 0.75), t + "down": whole(n * (0.5 + col("tt")) + n * col("z") * 0.75),
        t + "part": col("tt") - F.floor("__hp_tt"), t + "width": n * F.sqrt(3 * (1 - F.abs(t + "z"))),
    })
    out = out.withColumns({
        t + "ring": col("up") - col("down") + (n + 1), t + "i": whole(col("part") * col("width")) + whole((1 - col("part")) * col("width")) + 1,
    })
    odd = 1 - F.pmod(col("ring"), F.lit(2))
    ip = F.pmod(F.floor((col("up") + col("down") - n + odd + 1) / 2).cast("bigint"), F.lit(4 * n))
    out = out.withColumns({t + "belt": (col("ring") - 1) * (4 * n) + ip + 2 * n * (n - 1), t + "j": F.pmod(whole(col("tt") * col("i")), 4 * col("i"))})
    cap = F.when(col("z") > 0, 2 * col("i") * (col("i") - 1) + col("j")).otherwise(F.lit(npix(n)) - 2 * col("i") * (col("i") + 1) + col("j"))
    value = F.when(F.abs(t + "z") <= 2 / 3, col("belt")).otherwise(cap)
    # a filter on the pixel (any join makes one) stays above a generator; pushed below, it would repeat every step
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def pixel_table(spark: SparkSession, nside: int) -> DataFrame:
    """``pix, theta_pix, phi_pix, nx, ny, nz`` of all pixel centres, made by Spark from a range of pixel numbers.

    A cap's ring ``i`` has ``4 i`` pixels, a ring of the belt ``4 nside``; the south cap mirrors the north one.
    """
    n, total, n_cap = nside, npix(nside), 2 * nside * (nside - 1)
    pix, back = F.col("pix"), F.lit(total - 1) - F.col("pix")
    ring_of = lambda p: F.floor((1 + F.sqrt(1 + 2 * p.cast("double"))) / 2)
    north, south = pix < n_cap, pix >= total - n_cap
    out = spark.range(total).select(F.col("id").alias("pix")).withColumn("i", F.when(north, ring_of(pix)).when(south, ring_of(back)).otherwise(F.floor((pix - n_cap) / (4 * n)) + n))
    i = F.col("i")
    height = F.when(north, 1 - i * i / (3.0 * n * n)).when(south, i * i / (3.0 * n * n) - 1).otherwise(4 / 3 - 2 * i / (3.0 * n))
    shift = F.when((i + n) % 2 == 0, 0.5).otherwise(0.0)
    turn = (
        F.when(north, (pix - 2 * i * (i - 1) + 0.5) / i)
        .when(south, (4 * i - (back - 2 * i * (i - 1)) - 0.5) / i)
        .otherwise(((pix - n_cap) % (4 * n) + shift) / n)
    )
    out = out.withColumns({"theta_pix": F.acos(F.least(F.greatest(height, F.lit(-1.0)), F.lit(1.0))), "phi_pix": turn * HALF_PI})
    theta, phi = F.col("theta_pix"), F.col("phi_pix")
    return out.select("pix", "theta_pix", "phi_pix", (F.sin(theta) * F.cos(phi)).alias("nx"), (F.sin(theta) * F.sin(phi)).alias("ny"), F.cos(theta).alias("nz"))


def pixel_neighbors(spark: SparkSession, nside: int, radius: float) -> DataFrame:
    """``pix, near, angle`` for all pixel pairs within ``radius`` radians, a pixel itself included.

    A radius join of the centres on grid cells, by Spark; ``neighbor_rows`` tells about how many rows it has.
    """
    from orbitrace.operators.neighbors import radius_pairs

    centers = pixel_table(spark, nside).select("pix", "nx", "ny", "nz")
    chord = 2 * math.sin(min(radius, math.pi) / 2) + 1e-9
    pairs = radius_pairs(centers, centers, chord, frame=None, axes=("nx", "ny", "nz"))
    out = pairs.select("pix", F.col("n_pix").alias("near"), (2 * F.asin(F.least(F.col("distance") / 2, F.lit(1.0)))).alias("angle"))
    return out.where((F.col("angle") <= radius) | (F.col("pix") == F.col("near")))


def neighbor_rows(nside: int, radius: float) -> float:
    """About how many rows ``pixel_neighbors`` has: pixels times the pixels of a cap."""
    return npix(nside) * max(1.0, npix(nside) * (1 - math.cos(min(radius, math.pi))) / 2)
