"""Row-wise geometry as column expressions: spheres, tangent planes, map projections, harmonics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi
CENTER = ("center_x_smooth", "center_y_smooth", "center_z_smooth")
RADIUS = "radius_smooth"


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def to_spherical(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """Radius, polar angle and longitude in [0, 2 pi); at the origin the angles are null."""
    r = norm(dx, dy, dz)
    theta = F.when(r > 0, F.acos(clip(dz / r, -1.0, 1.0)))
    phi = F.atan2(dy, dx)
    return r, theta, F.when(phi < 0, phi + TWO_PI).otherwise(phi)


def to_cartesian(r: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)


def rescale(df: DataFrame, voxel_size: dict[str, float]) -> DataFrame:
    """Coordinates times the voxel size of their axis."""
    return df.withColumns({axis: F.col(axis) * F.lit(float(s)) for axis, s in voxel_size.items()})


def keep_class(df: DataFrame, classes=(0,), t_range: tuple[int | None, int | None] = (None, None), column: str = "track_class") -> DataFrame:
    """Rows of some classes and of frames from the first to the last of ``t_range``; both filters reach the scan."""
    out = df.where(F.col(column).isin(*classes))
    low, high = t_range
    if low is not None:
        out = out.where(F.col("t") >= low)
    return out if high is None else out.where(F.col("t") <= high)


def frame_time(t: Column, step_s: float = 90.0, start_hours: float = 26.0) -> tuple[Column, Column]:
    """Minutes since the first frame, and developmental stage in hours."""
    minutes = t * F.lit(step_s) / 60.0
    return minutes, F.lit(start_hours) + minutes / 60.0


def centered(df: DataFrame, sphere: DataFrame, how: str = "left") -> DataFrame:
    """``df`` joined to its frame's sphere fit, with ``dx, dy, dz``. The sphere table has one row a frame."""
    fit = sphere.select("t", *CENTER, RADIUS)
    return df.join(fit, "t", how).withColumns({f"d{a}": F.col(a) - F.col(c) for a, c in zip("xyz", CENTER, strict=True)})


def add_sphere_coords(df: DataFrame, sphere: DataFrame, how: str = "left") -> DataFrame:
    """``df`` with ``r, theta, phi`` about the centre of its frame; frames without a fit get nulls, or go with ``inner``."""
    out = centered(df, sphere, how)
    r, theta, phi = to_spherical(F.col("dx"), F.col("dy"), F.col("dz"))
    return out.withColumns({"r": r, "theta": theta, "phi": phi}).drop("dx", "dy", "dz", *CENTER, RADIUS)


def project_to_sphere(df: DataFrame, sphere: DataFrame) -> DataFrame:
    """``df`` with unit vector ``ux, uy, uz`` and the surface point ``px, py, pz``."""
    out = centered(df, sphere, "inner")
    n = F.greatest(norm(F.col("dx"), F.col("dy"), F.col("dz")), F.lit(1e-12))
    out = out.withColumns({f"u{a}": F.col(f"d{a}") / n for a in "xyz"})
    out = out.withColumns({f"p{a}": F.col(c) + F.col(RADIUS) * F.col(f"u{a}") for a, c in zip("xyz", CENTER, strict=True)})
    return out.drop("dx", "dy", "dz", *CENTER, RADIUS)


def radial_outliers(df: DataFrame, sphere: DataFrame, k: float = 2.0) -> DataFrame:
    """``df`` with ``r_dev`` and ``is_outlier``: more than ``k`` population deviations of all rows. One small aggregate is joined."""
    out = centered(df, sphere, "inner")
    out = out.withColumn("r_dev", norm(F.col("dx"), F.col("dy"), F.col("dz")) - F.col(RADIUS))
    spread = out.agg(F.stddev_pop("r_dev").alias("__s"))  # one row
    out = out.join(F.broadcast(spread)).withColumn("is_outlier", F.abs("r_dev") > k * F.col("__s"))
    return out.drop("__s", "dx", "dy", "dz", *CENTER, RADIUS)


def shell(df: DataFrame, sphere: DataFrame, distance: float) -> DataFrame:
    """Rows within ``distance`` of their frame's sphere."""
    out = centered(df, sphere, "inner").where(F.abs(norm(F.col("dx"), F.col("dy"), F.col("dz")) - F.col(RADIUS)) <= distance)
    return out.drop("dx", "dy", "dz", *CENTER, RADIUS)


def rotation_to_pole(up: tuple[float, float, float]) -> list[list[float]]:
    """Rotation that takes a direction to +z (Rodrigues)."""
    n = math.sqrt(sum(c * c for c in up)) or 1.0
    x, y, z = (c / n for c in up)
    axis_x, axis_y, s = y, -x, math.hypot(x, y)
    if s < 1e-12:
        return [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]] if z > 0 else [[1.0, 0, 0], [0, -1.0, 0], [0, 0, -1.0]]
    a, b = axis_x / s, axis_y / s
    c = z
    return [
        [c + a * a * (1 - c), a * b * (1 - c), b * s],
        [a * b * (1 - c), c + b * b * (1 - c), -a * s],
        [-b * s, a * s, c],
    ]


def rotate_up(df: DataFrame, sphere: DataFrame, early_frames: int = 5, shift: float = 0.0) -> DataFrame:
    """``theta_rot, phi_rot`` after the early frames' centre of mass has become the pole; longitude in (-pi, pi].

    The mean direction is one aggregate row, joined as a literal would be; no data goes through the driver but that row.
    """
    base = centered(df, sphere, "inner")
    mean = base.where(F.col("t") < early_frames).agg(*(F.avg(f"d{a}").alias(a) for a in "xyz")).first()
    m = rotation_to_pole(tuple(mean[a] or 0.0 for a in "xyz"))
    d = [F.col(f"d{a}") for a in "xyz"]
    rot = [sum((F.lit(m[i][j]) * d[j] for j in range(1, 3)), F.lit(m[i][0]) * d[0]) for i in range(3)]
    n = norm(*rot)
    phi = F.atan2(rot[1], rot[0]) + shift
    wrapped = F.lit(math.pi) - F.pmod(F.lit(math.pi) - phi, F.lit(TWO_PI))
    out = base.withColumns({"theta_rot": F.acos(clip(rot[2] / n, -1.0, 1.0)), "phi_rot": wrapped})
    return out.drop("dx", "dy", "dz", *CENTER, RADIUS)


def laea(theta: Column, phi: Column, phi0: float = 0.0, north: bool = True) -> tuple[Column, Column]:
    """Lambert azimuthal equal-area coordinates about a pole, on the unit sphere (the equator has radius sqrt 2)."""
    t = theta if north else F.lit(math.pi) - theta
    rho = 2 * F.sin(t / 2)
    return rho * F.cos(phi - phi0), rho * F.sin(phi - phi0)


def laea_inverse(px: Column, py: Column, phi0: float = 0.0, north: bool = True) -> tuple[Column, Column]:
    t = 2 * F.asin(clip(F.sqrt(px * px + py * py) / 2, 0.0, 1.0))
    return (t if north else F.lit(math.pi) - t), F.pmod(F.atan2(py, px) + phi0, F.lit(TWO_PI))


def in_disk(px: Column, py: Column) -> Column:
    return px * px + py * py <= 2.0


def recentre(phi: Column, phi0: float) -> Column:
    """Longitude relative to ``phi0`` in [-pi, pi)."""
    return F.pmod(phi - phi0 + math.pi, F.lit(TWO_PI)) - math.pi


def tangent_basis(n: tuple[Column, Column, Column]) -> tuple[tuple[Column, Column, Column], tuple[Column, Column, Column]]:
    """Two unit tangents ``e_theta`` (towards the reference axis) and ``e_phi = e_theta x n`` reversed, i.e. ``ref x n``.

    The reference axis is z, or y where the normal is within about 18 degrees of z. With ``n`` they make a left-handed
    frame, so a curl in this basis is minus the outward one.
    """
    nx, ny, nz = n
    polar = F.abs(nz) > 0.95
    rx, ry, rz = F.lit(0.0), F.when(polar, 1.0).otherwise(0.0), F.when(polar, 0.0).otherwise(1.0)
    dot = rx * nx + ry * ny + rz * nz
    tx, ty, tz = rx - dot * nx, ry - dot * ny, rz - dot * nz
    s = norm(tx, ty, tz)
    tx, ty, tz = tx / s, ty / s, tz / s
    return (tx, ty, tz), (ny * tz * -1 + nz * ty, nz * tx * -1 + nx * tz, nx * ty * -1 + ny * tx)


def angle_between(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.acos(clip(a[0] * b[0] + a[1] * b[1] + a[2] * b[2], -1.0, 1.0))


def geodesic_step(prev: tuple[Column, ...], curr: tuple[Column, ...]) -> tuple[Column, Column, Column]:
    """The unit vector reached when the great-circle motion from ``prev`` to ``curr`` goes on for as long again."""
    dot = clip(sum((p * c for p, c in zip(prev[1:], curr[1:], strict=True)), prev[0] * curr[0]), -1.0, 1.0)
    return tuple(2 * dot * c - p for p, c in zip(prev, curr, strict=True))


def closest_on_sphere(point: tuple[Column, ...], center: tuple[Column, ...], radius: Column) -> tuple[Column, Column, Column]:
    d = [p - c for p, c in zip(point, center, strict=True)]
    n = F.greatest(norm(*d), F.lit(1e-12))
    return tuple(c + radius * x / n for c, x in zip(center, d, strict=True))


def parse_int_list(c: Column) -> Column:
    """``"[1 2 5]"`` to an array of bigint; null and empty brackets give an empty array."""
    bare = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\],]+", " "))
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.split(bare, r"\s+").cast("array<bigint>"))


def angle_bins(theta: Column, phi: Column, n_theta: int, n_phi: int) -> tuple[Column, Column]:
    """Nearest node of an ``n_theta`` by ``n_phi`` grid; halves go to the even node."""
    return F.rint(theta / math.pi * (n_theta - 1)).cast("int"), F.pmod(F.rint(phi / TWO_PI * n_phi).cast("int"), F.lit(n_phi))


def fwhm_to_sigma(fwhm: float) -> float:
    """Gaussian sigma of a full width at half maximum; 1 where there is no width."""
    return fwhm / (2 * math.sqrt(2 * math.log(2))) if fwhm > 0 else 1.0


def legendre(l_max: int, x: Column) -> dict[tuple[int, int], Column]:
    """Associated Legendre functions without the sign of Condon and Shortley, by the standard recurrences."""
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - x * x))
    p: dict[tuple[int, int], Column] = {(0, 0): F.lit(1.0)}
    for m in range(1, l_max + 1):
        p[m, m] = p[m - 1, m - 1] * s * (2 * m - 1)
    for m in range(l_max):
        p[m + 1, m] = x * (2 * m + 1) * p[m, m]
    for m in range(l_max + 1):
        for n in range(m + 2, l_max + 1):
            p[n, m] = (x * (2 * n - 1) * p[n - 1, m] - p[n - 2, m] * (n + m - 1)) / (n - m)
    return p


def real_harmonics(l_max: int, theta: Column, phi: Column) -> dict[tuple[int, int], Column]:
    """Orthonormal real spherical harmonics by degree and order."""
    p, out = legendre(l_max, F.cos(theta)), {}
    for n in range(l_max + 1):
        for m in range(-n, n + 1):
            k = abs(m)
            scale = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k))
            if m == 0:
                out[n, m] = p[n, 0] * scale
            else:
                out[n, m] = p[n, k] * (F.cos(k * phi) if m > 0 else F.sin(k * phi)) * (scale * math.sqrt(2))
    return out
