"""Row-wise geometry over the tracks of ``events``."""

from __future__ import annotations


from pyspark.sql import functions as F

from orbitrace.functions import geometry as G
from orbitrace.functions import healpix as H
from orbitrace.operators.lineage import approach_speed
from orbitrace.operators.tracks import in_track
from orbitrace.plans.registry import query, rounded
from orbitrace.sources.testviews import WITH_SPHERE, WITH_TRACKS, sphere, tracks


def R(e: str) -> str:
    return f"round({e}, 6) + 0.0e0"


CENTERED = """cen AS (SELECT k.*, k.x - s.center_x_smooth AS dx, k.y - s.center_y_smooth AS dy, k.z - s.center_z_smooth AS dz, s.radius_smooth AS rad
  FROM tracks AS k JOIN sphere AS s ON k.t = s.t)"""
ANGLES = f"""{CENTERED}, a AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS r,
  acos(least(greatest(dz / sqrt(dx*dx + dy*dy + dz*dz), -1.0e0), 1.0e0)) AS theta,
  CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + 2 * pi() ELSE atan2(dy, dx) END AS phi FROM cen)"""
UNITS = f"""{CENTERED}, u AS (SELECT *, dx / sqrt(dx*dx + dy*dy + dz*dz) AS ux, dy / sqrt(dx*dx + dy*dy + dz*dz) AS uy,
  dz / sqrt(dx*dx + dy*dy + dz*dz) AS uz FROM cen)"""


@query(f"{WITH_TRACKS} SELECT track_id, t, {R('x * 0.5e0')} AS x, {R('y * 0.5e0')} AS y, {R('z * 2.5e0')} AS z FROM tracks")
def b01_rescale(spark, sf):
    return rounded(G.rescale(tracks(spark, sf), {"x": 0.5, "y": 0.5, "z": 2.5}).select("track_id", "t", "x", "y", "z"))


@query(f"{WITH_TRACKS} SELECT track_id, t, track_class FROM tracks WHERE track_class = 0 AND t BETWEEN 5 AND 30")
def b02_class_and_range(spark, sf):
    return G.keep_class(tracks(spark, sf), (0,), (5, 30)).select("track_id", "t", "track_class")


@query(f"{WITH_TRACKS} SELECT track_id, t, {R('t * 1.5e0')} AS minutes, {R('26.0e0 + t * 1.5e0 / 60.0e0')} AS stage FROM tracks")
def b03_minutes_and_stage(spark, sf):
    minutes, stage = G.frame_time(F.col("t"))
    return rounded(tracks(spark, sf).select("track_id", "t", minutes.alias("minutes"), stage.alias("stage")))


@query(f"{WITH_TRACKS} SELECT track_id, t, mean_fluo > 50 AS is_bright FROM tracks WHERE mean_fluo > 20")
def b04_threshold(spark, sf):
    return tracks(spark, sf).where("mean_fluo > 20").select("track_id", "t", (F.col("mean_fluo") > 50).alias("is_bright"))


@query(f"{WITH_SPHERE}, {ANGLES} SELECT track_id, t, {R('r')} AS r, {R('theta')} AS theta, {R('phi')} AS phi FROM a")
def b05_sphere_coords(spark, sf):
    return rounded(G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf)).select("track_id", "t", "r", "theta", "phi"))


@query(f"{WITH_SPHERE}, {UNITS} SELECT track_id, t, {R('ux')} AS ux, {R('uy')} AS uy, {R('uz')} AS uz, {R('x - dx + rad * ux')} AS px FROM u")
def b06_project(spark, sf):
    return rounded(G.project_to_sphere(tracks(spark, sf), sphere(spark, sf)).select("track_id", "t", "ux", "uy", "uz", "px"))


@query(f"""{WITH_SPHERE}, {CENTERED}, d AS (SELECT track_id, t, sqrt(dx*dx + dy*dy + dz*dz) - rad AS r_dev FROM cen)
SELECT track_id, t, {R('r_dev')} AS r_dev, abs(r_dev) > 1.5e0 * (SELECT stddev_pop(r_dev) FROM d) AS is_outlier FROM d""")
def b07_radial_outliers(spark, sf):
    return rounded(G.radial_outliers(tracks(spark, sf), sphere(spark, sf), 1.5).select("track_id", "t", "r_dev", "is_outlier"))


@query(f"{WITH_SPHERE}, {CENTERED} SELECT track_id, t FROM cen WHERE abs(sqrt(dx*dx + dy*dy + dz*dz) - rad) <= 2.55e0")
def b08_shell(spark, sf):
    return G.shell(tracks(spark, sf), sphere(spark, sf), 2.55).select("track_id", "t")


@query(f"""{WITH_TRACKS}, q AS (SELECT track_id, t, x - 300.0e0 AS a, y - 600.0e0 AS b, z - 600.0e0 AS c FROM tracks)
SELECT track_id, t, {R('acos(least(greatest(a / sqrt(a*a + b*b + c*c), -1.0e0), 1.0e0))')} AS theta,
  {R('CASE WHEN atan2(b, c) < 0 THEN atan2(b, c) + 2 * pi() ELSE atan2(b, c) END')} AS phi FROM q""")
def b09_other_axes(spark, sf):
    """The same angles with x as the polar axis, y as the sine and z as the cosine of the longitude."""
    k = tracks(spark, sf)
    _, theta, phi = G.to_spherical(k.z - 600.0, k.y - 600.0, k.x - 300.0)
    return rounded(k.select("track_id", "t", theta.alias("theta"), phi.alias("phi")))


@query(f"{WITH_SPHERE}, {CENTERED} SELECT track_id, t, {R('dx')} AS dx, {R('dy')} AS dy, {R('dz')} AS dz FROM cen")
def b10_cartesian(spark, sf):
    """To spherical coordinates and back."""
    a = G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))
    dx, dy, dz = G.to_cartesian(F.col("r"), F.col("theta"), F.col("phi"))
    return rounded(a.select("track_id", "t", dx.alias("dx"), dy.alias("dy"), dz.alias("dz")))


@query(f"""{WITH_SPHERE}, {CENTERED}, m AS (SELECT avg(dx) AS a, avg(dy) AS b, avg(dz) AS c FROM cen WHERE t < 5),
n AS (SELECT a / sqrt(a*a + b*b + c*c) AS a, b / sqrt(a*a + b*b + c*c) AS b, c / sqrt(a*a + b*b + c*c) AS c FROM m),
k AS (SELECT a, b, c, b / sqrt(a*a + b*b) AS p, -a / sqrt(a*a + b*b) AS q, sqrt(a*a + b*b) AS s FROM n),
v AS (SELECT g.track_id, g.t, g.dx * k.c + k.q * k.s * g.dz + k.p * (k.p * g.dx + k.q * g.dy) * (1 - k.c) AS rx,
  g.dy * k.c - k.p * k.s * g.dz + k.q * (k.p * g.dx + k.q * g.dy) * (1 - k.c) AS ry,
  g.dz * k.c + k.s * (k.p * g.dy - k.q * g.dx) AS rz FROM cen AS g, k)
SELECT track_id, t, {R('acos(rz / sqrt(rx*rx + ry*ry + rz*rz))')} AS theta_rot, {R('atan2(ry, rx)')} AS phi_rot FROM v""")
def b11_rotate_to_pole(spark, sf):
    return rounded(G.rotate_up(tracks(spark, sf), sphere(spark, sf), 5).select("track_id", "t", "theta_rot", "phi_rot"))


def pix_sql(n: int) -> str:
    """The ring pixel of ``theta, phi`` in table ``a``, step by step."""
    return f"""h0 AS (SELECT *, cos(theta) AS hz, fmod(phi + 2 * pi(), 2 * pi()) / (pi() / 2) AS tt FROM a),
h1 AS (SELECT *, CAST(floor({n} * (0.5e0 + tt) - {n} * hz * 0.75e0) AS BIGINT) AS jp, CAST(floor({n} * (0.5e0 + tt) + {n} * hz * 0.75e0) AS BIGINT) AS jm,
  {n} * sqrt(3 * (1 - abs(hz))) AS wd, tt - floor(tt) AS tp FROM h0),
h2 AS (SELECT *, {n} + 1 + jp - jm AS ir, CAST(floor(tp * wd) AS BIGINT) + CAST(floor((1 - tp) * wd) AS BIGINT) + 1 AS ci FROM h1),
h3 AS (SELECT *, 1 - ((ir % 2) + 2) % 2 AS od, CAST(floor(tt * ci) AS BIGINT) % (4 * ci) AS cj FROM h2),
pix AS (SELECT *, CAST(CASE WHEN abs(hz) <= 2.0e0 / 3 THEN 2 * {n} * ({n} - 1) + (ir - 1) * 4 * {n}
    + ((CAST(floor((jp + jm - {n} + od + 1) / 2.0e0) AS BIGINT) % (4 * {n})) + 4 * {n}) % (4 * {n})
  WHEN hz > 0 THEN 2 * ci * (ci - 1) + cj ELSE 12 * {n} * {n} - 2 * ci * (ci + 1) + cj END AS BIGINT) AS pix FROM h3)"""


@query(f"{WITH_SPHERE}, {ANGLES}, {pix_sql(8)} SELECT track_id, t, pix FROM pix")
def b12_healpix(spark, sf):
    a = G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))
    return H.with_pixel(a, 8).select("track_id", "t", "pix")


@query(f"""{WITH_SPHERE}, {ANGLES} SELECT track_id, t, {R('2 * sin(theta / 2) * cos(phi - 0.5e0)')} AS px, {R('2 * sin(theta / 2) * sin(phi - 0.5e0)')} AS py,
  {R('theta')} AS theta_back, 4 * sin(theta / 2) * sin(theta / 2) <= 2.0e0 AS inside FROM a""")
def b13_equal_area(spark, sf):
    a = G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))
    px, py = G.laea(F.col("theta"), F.col("phi"), 0.5)
    m = a.select("track_id", "t", px.alias("px"), py.alias("py"))
    back, _ = G.laea_inverse(F.col("px"), F.col("py"), 0.5)
    return rounded(m.select("track_id", "t", "px", "py", back.alias("theta_back"), G.in_disk(F.col("px"), F.col("py")).alias("inside")))


@query(f"""{WITH_SPHERE}, {UNITS}, b AS (SELECT *, CASE WHEN abs(uz) > 0.95e0 THEN uy ELSE uz END AS d, abs(uz) > 0.95e0 AS p FROM u),
e AS (SELECT *, -d * ux AS ex, CASE WHEN p THEN 1.0e0 ELSE 0.0e0 END - d * uy AS ey, CASE WHEN p THEN 0.0e0 ELSE 1.0e0 END - d * uz AS ez FROM b),
f AS (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS s FROM e)
SELECT track_id, t, {R('ex / s')} AS ex, {R('ey / s')} AS ey, {R('ez / s')} AS ez, {R('(ey * uz - ez * uy) / s')} AS fx, {R('(ez * ux - ex * uz) / s')} AS fy,
  {R('(ex * uy - ey * ux) / s')} AS fz FROM f""")
def b14_tangent_basis(spark, sf):
    u = G.project_to_sphere(tracks(spark, sf), sphere(spark, sf))
    e, f = G.tangent_basis((F.col("ux"), F.col("uy"), F.col("uz")))
    return rounded(u.select("track_id", "t", *(c.alias(n) for c, n in zip((*e, *f), ("ex", "ey", "ez", "fx", "fy", "fz"), strict=True))))


@query(f"""{WITH_SPHERE}, {UNITS}, l AS (SELECT *, lag(ux) OVER w AS lx, lag(uy) OVER w AS ly, lag(uz) OVER w AS lz FROM u WINDOW w AS (PARTITION BY track_id ORDER BY t)),
d AS (SELECT *, least(greatest(ux * lx + uy * ly + uz * lz, -1.0e0), 1.0e0) AS d FROM l WHERE lx IS NOT NULL)
SELECT track_id, t, round(acos(d), 4) + 0.0e0 AS angle, {R('2 * d * ux - lx')} AS gx, {R('2 * d * uy - ly')} AS gy, {R('2 * d * uz - lz')} AS gz FROM d""")
def b15_geodesic_step(spark, sf):
    u = G.project_to_sphere(tracks(spark, sf), sphere(spark, sf))
    u = u.withColumns({f"l{a}": F.lag(f"u{a}").over(in_track()) for a in "xyz"}).where("lx IS NOT NULL")
    prev, curr = tuple(F.col(f"l{a}") for a in "xyz"), tuple(F.col(f"u{a}") for a in "xyz")
    g = G.geodesic_step(prev, curr)
    return rounded(u.select("track_id", "t", F.round(G.angle_between(prev, curr), 4).alias("angle"), *(c.alias(f"g{a}") for c, a in zip(g, "xyz", strict=True))))


@query(f"""{WITH_TRACKS}, d AS (SELECT track_id, t, sqrt((x - 600.0e0) * (x - 600.0e0) + (y - 600.0e0) * (y - 600.0e0) + (z - 800.0e0) * (z - 800.0e0)) AS d FROM tracks)
SELECT track_id, t, {R('d')} AS site_distance, {R('(lag(d) OVER (PARTITION BY track_id ORDER BY t) - d) / 1.5e0')} AS approach FROM d""")
def b16_approach_speed(spark, sf):
    return rounded(approach_speed(tracks(spark, sf), (600.0, 600.0, 800.0), 1.5).select("track_id", "t", "site_distance", "approach"))


@query("SELECT event_id, list_sum([event_id, user_id, event_id]) :: BIGINT AS total, 3 AS n FROM events")
def b17_parse_lists(spark, sf):
    """Lists written as text, such as ``[12 7 12]``, read back."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    text = F.concat(F.lit("["), F.col("event_id"), F.lit(" "), F.col("user_id"), F.lit("  "), F.col("event_id"), F.lit("]"))
    p = e.select("event_id", G.parse_int_list(text).alias("v"))
    return p.select("event_id", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"), F.size("v").alias("n"))


@query(f"""{WITH_SPHERE}, {ANGLES} SELECT track_id, t, CAST(round_even(theta / pi() * 18, 0) AS INT) AS i,
  CAST(round_even(phi / (2 * pi()) * 36, 0) AS INT) % 36 AS j FROM a""")
def b18_angle_bins(spark, sf):
    a = G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))
    i, j = G.angle_bins(F.col("theta"), F.col("phi"), 19, 36)
    return a.select("track_id", "t", i.alias("i"), j.alias("j"))


@query(f"""{WITH_SPHERE}, {ANGLES} SELECT track_id, t, {R('0.5e0 * sqrt(1 / pi())')} AS y00, {R('sqrt(3 / (4 * pi())) * cos(theta)')} AS y10,
  {R('sqrt(3 / (4 * pi())) * sin(theta) * cos(phi)')} AS y11, {R('sqrt(3 / (4 * pi())) * sin(theta) * sin(phi)')} AS y1m,
  {R('sqrt(5 / (16 * pi())) * (3 * cos(theta) * cos(theta) - 1)')} AS y20, {R('sqrt(15 / (16 * pi())) * sin(theta) * sin(theta) * cos(2 * phi)')} AS y22 FROM a""")
def b20_harmonics(spark, sf):
    a = G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))
    y = G.real_harmonics(2, F.col("theta"), F.col("phi"))
    names = {(0, 0): "y00", (1, 0): "y10", (1, 1): "y11", (1, -1): "y1m", (2, 0): "y20", (2, 2): "y22"}
    return rounded(a.select("track_id", "t", *(y[k].alias(n) for k, n in names.items())))
