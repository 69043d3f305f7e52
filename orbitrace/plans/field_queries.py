"""Cells, fields, clusters, surfaces and regions over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from orbitrace.functions import geometry as G
from orbitrace.functions.healpix import pixel_area, pixel_neighbors, with_pixel
from orbitrace.operators import cells as C
from orbitrace.operators import clusters as K
from orbitrace.operators import fields as D
from orbitrace.operators import lineage as L
from orbitrace.operators import materials as P
from orbitrace.operators import neighbors as N
from orbitrace.operators import regions as V
from orbitrace.operators import stats as S
from orbitrace.operators import surface as U
from orbitrace.operators.blocks import near_rows
from orbitrace.operators.graph import connected_components
from orbitrace.operators.tracks import preprocess_tracks, step_table
from orbitrace.plans import field_sql as Q
from orbitrace.plans.field_sql import COMPONENTS, RECURSIVE, STEP_SQL
from orbitrace.plans.geometry_queries import ANGLES, UNITS, R, pix_sql
from orbitrace.plans.registry import query, rounded
from orbitrace.session import materialize
from orbitrace.sources import tables as A
from orbitrace.sources.testviews import WITH_SPHERE, WITH_TRACKS, WITH_VOXELS, sphere, table, tracks, voxels

NEAR = """n AS (SELECT a.track_id, a.t, b.track_id AS k, b.mean_fluo AS f FROM tracks AS a JOIN tracks AS b ON a.t = b.t
  WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 22500)"""
V0 = """v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, z - lag(z) OVER w AS vz FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t)),
m AS (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS s FROM v WHERE sqrt(vx*vx + vy*vy + vz*vz) > 0)"""


def _units(spark, sf):
    return G.project_to_sphere(tracks(spark, sf), sphere(spark, sf)).drop("px", "py", "pz")


def _angles(spark, sf):
    return G.add_sphere_coords(tracks(spark, sf), sphere(spark, sf))


def _steps(spark, sf):
    k = tracks(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return step_table(k, sphere(spark, sf))


@query(f"""{WITH_TRACKS}, {NEAR}, d AS (SELECT t, track_id, count(*) AS n, avg(f) AS f FROM n GROUP BY ALL)
SELECT t, count(*) AS n_cells, {R('avg(n / (pi() * 22500.0e0)) * 1000')} AS density, {R('avg(f)')} AS fluo_nn FROM d GROUP BY t""")
def entry_cell_summary(spark, sf):
    """Tracks cleaned, neighbour density and mean neighbour fluorescence per cell, averaged per frame."""
    k = preprocess_tracks(tracks(spark, sf))
    d = C.local_density(k, 150.0, ("mean_fluo",))
    return rounded(d.groupBy("t").agg(F.count("*").alias("n_cells"), (F.avg("density") * 1000).alias("density"), F.avg("mean_fluo_nn").alias("fluo_nn")))


@query(f"""{WITH_TRACKS}, {NEAR} SELECT track_id, t, count(*) AS n_near, {R('count(*) / (pi() * 22500.0e0) * 1000')} AS density, {R('avg(f)')} AS mean_fluo_nn FROM n GROUP BY ALL""")
def d18_local_density(spark, sf):
    d = C.local_density(tracks(spark, sf), 150.0, ("mean_fluo",))
    return rounded(d.select("track_id", "t", "n_near", (F.col("density") * 1000).alias("density"), "mean_fluo_nn"))


@query(f"""{WITH_TRACKS}, d AS (SELECT a.track_id, a.t, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND a.track_id <> b.track_id),
r AS (SELECT *, row_number() OVER (PARTITION BY t, track_id ORDER BY d) AS r FROM d), q AS (SELECT track_id, t, max(d) AS rk, count(*) AS n FROM r WHERE r <= 4 GROUP BY ALL),
s AS (SELECT t, count(*) AS c FROM tracks GROUP BY t)
SELECT k.track_id, k.t, {R('CASE WHEN s.c >= 5 THEN q.n / (pi() * q.rk * q.rk) * 1000 END')} AS knn_density FROM tracks AS k JOIN s ON s.t = k.t LEFT JOIN q ON q.t = k.t AND q.track_id = k.track_id""")
def d19_knn_density(spark, sf):
    d = C.knn_density(tracks(spark, sf), 4, 80.0)
    return rounded(d.select("track_id", "t", (F.col("knn_density") * 1000).alias("knn_density")))


@query(f"""{WITH_SPHERE}, {UNITS}, d AS (SELECT a.track_id, a.t, 2 * asin(least(sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) / 2, 1.0e0)) AS g, b.mean_fluo AS f
  FROM u AS a JOIN u AS b ON a.t = b.t AND a.track_id <> b.track_id), r AS (SELECT *, row_number() OVER (PARTITION BY t, track_id ORDER BY g) AS r FROM d)
SELECT track_id, t, {R('CASE WHEN max(g) > 0 THEN count(*) / (2 * pi() * 250000.0e0 * (1 - cos(max(g)))) * 1000 END')} AS sphere_density, {R('avg(f)')} AS fluo_mean_nn, {R('sum(f)')} AS fluo_sum_nn
FROM r WHERE r <= 4 GROUP BY ALL""")
def d20_spherical_density(spark, sf):
    d = C.spherical_knn_density(_units(spark, sf), 4, 0.16)
    return rounded(d.withColumn("sphere_density", F.col("sphere_density") * 1000))


@query(f"""{WITH_TRACKS}, {V0} SELECT k.track_id, k.t, {R('avg((a.vx * b.vx + a.vy * b.vy + a.vz * b.vz) / (a.s * b.s))')} AS alignment FROM tracks AS k LEFT JOIN m AS a ON a.track_id = k.track_id AND a.t = k.t
LEFT JOIN m AS b ON b.t = a.t AND b.track_id <> a.track_id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 22500 GROUP BY ALL""")
def d21_velocity_alignment(spark, sf):
    return rounded(C.velocity_alignment(tracks(spark, sf), 150.0))


@query(f"""{WITH_TRACKS}, v AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2) + power(z - lag(z) OVER w, 2)) AS s FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t)),
l AS (SELECT a.track_id, a.t, a.x, a.y, a.z, list(b.s ORDER BY b.t) AS s FROM v AS a JOIN v AS b ON a.track_id = b.track_id AND b.t BETWEEN a.t - 5 AND a.t + 5 AND b.s IS NOT NULL GROUP BY ALL),
p AS (SELECT a.track_id, a.t, b.track_id AS k, a.s[i] AS x, b.s[i] AS y FROM l AS a JOIN l AS b ON a.t = b.t AND a.track_id <> b.track_id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 22500,
  unnest(range(1, least(len(a.s), len(b.s)) + 1)) AS q(i)),
c AS (SELECT track_id, t, k, corr(x, y) AS c FROM p GROUP BY ALL HAVING count(*) >= 2 AND max(x) > min(x) AND max(y) > min(y)), f AS (SELECT track_id, t, avg(c) AS c FROM c GROUP BY ALL)
SELECT k.track_id, k.t, {R('f.c')} AS correlation FROM tracks AS k LEFT JOIN f ON f.track_id = k.track_id AND f.t = k.t""")
def e21_speed_correlation(spark, sf):
    return rounded(C.windowed_correlation(tracks(spark, sf), 150.0, 5))


@query(f"""{WITH_TRACKS}, v AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, z - lag(z) OVER w AS vz FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t)),
l AS (SELECT a.track_id, a.t, a.x, a.y, a.z, flatten(list([b.vx, b.vy, b.vz] ORDER BY b.t)) AS s FROM v AS a JOIN v AS b ON a.track_id = b.track_id AND b.t BETWEEN a.t - 5 AND a.t + 5 AND b.vx IS NOT NULL GROUP BY ALL),
p AS (SELECT a.track_id, a.t, b.track_id AS k, a.s[i] AS x, b.s[i] AS y FROM l AS a JOIN l AS b ON a.t = b.t AND a.track_id <> b.track_id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 22500,
  unnest(range(1, least(len(a.s), len(b.s)) + 1)) AS q(i)),
c AS (SELECT track_id, t, k, corr(x, y) AS c FROM p GROUP BY ALL HAVING count(*) >= 3 AND max(x) > min(x) AND max(y) > min(y)), f AS (SELECT track_id, t, avg(c) AS c FROM c GROUP BY ALL)
SELECT k.track_id, k.t, {R('f.c')} AS correlation FROM tracks AS k LEFT JOIN f ON f.track_id = k.track_id AND f.t = k.t""")
def e22_velocity_correlation(spark, sf):
    return rounded(C.windowed_correlation(tracks(spark, sf), 150.0, 5, vector=True, least=3))


@query(f"""{WITH_TRACKS}, g AS (SELECT *, avg(mean_fluo) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g FROM tracks),
r AS (SELECT a.track_id, a.t, b.g, row_number() OVER (PARTITION BY a.t, a.track_id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), b.track_id) AS r FROM g AS a JOIN g AS b ON a.t = b.t)
SELECT track_id, t, {R('avg(g)')} AS mean_fluo_knn FROM r WHERE r <= 4 GROUP BY ALL""")
def e23_knn_smooth(spark, sf):
    return rounded(C.knn_smooth(tracks(spark, sf), ["mean_fluo"], 4, 80.0).select("track_id", "t", "mean_fluo_knn"))


@query(f"""{WITH_SPHERE}, {UNITS} SELECT a.track_id, a.t, b.track_id AS n_track_id FROM u AS a JOIN u AS b ON a.t = b.t AND a.track_id <> b.track_id
WHERE sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) <= 2 * sin(0.1e0)""")
def c07_angular_pairs(spark, sf):
    u = _units(spark, sf)
    return near_rows(u, u, 2 * math.sin(0.1), axes=("ux", "uy", "uz"), include_self=False).select("track_id", "t", "n_track_id")


@query(f"""{WITH_SPHERE}, {UNITS}, c AS (SELECT a.track_id, a.t, count(*) AS c FROM u AS a JOIN u AS b ON a.t = b.t WHERE sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) <= 2 * sin(0.2e0) GROUP BY ALL),
n AS (SELECT t, count(*) AS n FROM u GROUP BY t) SELECT c.track_id, c.t, CAST(least(c.c, least(64, greatest(8, floor(sqrt(n.n))))) - 1 AS BIGINT) AS degree FROM c JOIN n ON c.t = n.t""")
def c09_degree(spark, sf):
    return C.degree_within(_units(spark, sf), sphere(spark, sf), 200.0)


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)} SELECT CAST(i AS INT) AS t_idx, {R('i * 6.0e0')} AS time_center, pix, count(*) AS n FROM pix,
unnest(range(0, CAST(ceil((SELECT max(t) FROM tracks) * 1.5e0 / 6 + 1 - 1e-9) AS INT))) AS u(i) WHERE abs(t * 1.5e0 - i * 6) <= 10 GROUP BY ALL""")
def d15_window_counts(spark, sf):
    a = _angles(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return rounded(D.window_counts(a, 4, 20.0, 6.0))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)} SELECT t, pix, count(*) AS n, {R('sum(mean_fluo)')} AS sum, {R('avg(mean_fluo)')} AS mean, {R('max(mean_fluo)')} AS max FROM pix GROUP BY ALL""")
def d16_pixel_stats(spark, sf):
    return rounded(D.pixel_stats(_angles(spark, sf), 4, "mean_fluo"))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)} SELECT t, pix, count(*) AS n, {R(f'count(*) / {pixel_area(4)!r}')} AS density, {R('avg(mean_fluo) FILTER (mean_fluo <= 90)')} AS mean_mean_fluo FROM pix GROUP BY ALL""")
def d17_pixel_density(spark, sf):
    a = _angles(spark, sf).withColumn("odd", F.col("mean_fluo") > 90)
    return rounded(D.pixel_density(a, 4, outlier="odd", mean_of=("mean_fluo",)))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, n AS (SELECT t, pix, count(*) AS n FROM pix GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY t) AS p FROM n),
e AS (SELECT t, -sum(p * ln(p + 1e-16)) AS entropy FROM p GROUP BY t), d AS (SELECT coalesce(a.t, b.t + 1) AS t, sum(power(coalesce(a.p, 0) - coalesce(b.p, 0), 2)) AS c FROM p AS a FULL JOIN p AS b ON a.t = b.t + 1 AND a.pix = b.pix GROUP BY ALL)
SELECT e.t, {R('e.entropy')} AS entropy, {R('CASE WHEN e.t > 0 THEN d.c END')} AS change FROM e JOIN d ON d.t = e.t""")
def d40_density_entropy(spark, sf):
    return rounded(D.density_entropy(D.pixel_stats(_angles(spark, sf), 4, "mean_fluo").select("t", "pix", "n")))


@query(f"""{WITH_SPHERE}, {UNITS}, f AS (SELECT t, ux, uy, uz, mean_fluo - avg(mean_fluo) OVER (PARTITION BY t) AS f, row_number() OVER (PARTITION BY t ORDER BY track_id) AS i,
  row_number() OVER (PARTITION BY t ORDER BY md5(CAST(track_id AS VARCHAR)), track_id) AS j FROM u), g AS (SELECT a.*, b.f AS g FROM f AS a JOIN f AS b ON a.t = b.t AND b.j = a.i)
SELECT t, {R('sqrt(power(sum(f * ux), 2) + power(sum(f * uy), 2) + power(sum(f * uz), 2))')} AS dipole, {R('sqrt(power(sum(g * ux), 2) + power(sum(g * uy), 2) + power(sum(g * uz), 2))')} AS dipole_null FROM g GROUP BY t""")
def d41_dipole(spark, sf):
    return rounded(D.dipole(_units(spark, sf), "mean_fluo").select("t", "dipole", "dipole_null"))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, n AS (SELECT pix, count(*) AS n FROM pix GROUP BY pix), k AS (SELECT * FROM n ORDER BY n DESC, pix LIMIT 10)
SELECT pix, n, {R('n / sum(n) OVER ()')} AS weight FROM k""")
def f03_top_pixels(spark, sf):
    n = D.pixel_stats(_angles(spark, sf), 4, "mean_fluo").groupBy("pix").agg(F.sum("n").alias("n"))
    return rounded(D.top_pixels(n, 10))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, n AS (SELECT pix, count(*) AS n FROM pix GROUP BY pix)
SELECT pix, n, n >= 50 AS ok_vector, n >= 150 AS ok_materials, n >= 100 AS ok_metrics, n >= 8 AS ok_density FROM n""")
def d39_qc_masks(spark, sf):
    n = D.pixel_stats(_angles(spark, sf), 4, "mean_fluo").groupBy("pix").agg(F.sum("n").alias("n"))
    return D.qc_masks(n)


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, m AS (SELECT pix, avg(mean_fluo) AS v FROM pix WHERE t = (SELECT max(t) FROM tracks) GROUP BY pix)
SELECT {R('quantile_cont(v, 0.01)')} AS low, {R('quantile_cont(v, 0.975)')} AS high FROM m WHERE v > 0""")
def d48_display_bounds(spark, sf):
    return rounded(S.display_bounds(D.pixel_stats(_angles(spark, sf), 4, "mean_fluo"), "mean"))


@query(Q.D22)
def d22_density_field(spark, sf):
    return rounded(D.density_field(_steps(spark, sf), 4, 0.2, 45.0, 15.0, dense=True))


@query(Q.D23)
def d23_vector_field(spark, sf):
    return rounded(D.vector_field(_steps(spark, sf), 4, 0.3, 500.0, 45.0, 15.0), 4)


@query(Q.D24)
def d24_path_speed(spark, sf):
    return rounded(D.path_speed(_steps(spark, sf), 4, 0.3, 500.0, 45.0, 15.0))


@query(Q.D25)
def d25_pair_alignment(spark, sf):
    return rounded(D.pair_alignment(_steps(spark, sf), 4, 0.3, 45.0, 15.0))


@query(Q.D26)
def d26_misalignment_entropy(spark, sf):
    return rounded(D.misalignment_entropy(_steps(spark, sf), 4, 0.15, 45.0, 15.0))


@query(Q.D36)
def d36_msd_exponents(spark, sf):
    points = _angles(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return rounded(D.pixel_msd_exponent(points, 2, 45.0, 15.0))


@query()
def d29_material_fields(spark, sf):
    """Every seventh step takes half an hour more, so that there are long steps beside the short ones."""
    k = tracks(spark, sf).withColumn("time_min", F.col("t") * 1.5 + F.floor(F.col("t") / 7) * 30.0)
    return rounded(P.material_fields(step_table(k, sphere(spark, sf)), 2, 0.3, 10, 180.0, 60.0), 4)


@query(f"""{STEP_SQL} SELECT track_id, t, {R('vx')} AS vx, {R('mx')} AS mx, {R('radius')} AS radius, {R('theta')} AS theta, {R('phi')} AS phi, {R('(t - 0.5e0) * 1.5e0')} AS mid_time, {R('mid_fluo')} AS mid_fluo FROM a""")
def e06_step_table(spark, sf):
    return rounded(_steps(spark, sf).select("track_id", "t", "vx", "mx", "radius", "theta", "phi", "mid_time", "mid_fluo"))


@query(f"""{STEP_SQL}, {pix_sql(2)}, d AS (SELECT pix, track_id, t, vx * 1.5e0 - avg(vx * 1.5e0) OVER p AS a, vy * 1.5e0 - avg(vy * 1.5e0) OVER p AS b, vz * 1.5e0 - avg(vz * 1.5e0) OVER p AS c FROM pix WINDOW p AS (PARTITION BY pix)),
l AS (SELECT *, a * lag(a) OVER w AS la, b * lag(b) OVER w AS lb, c * lag(c) OVER w AS lc FROM d WINDOW w AS (PARTITION BY pix, track_id ORDER BY t)),
s AS (SELECT pix, count(*) AS n, (avg(a * a) + avg(b * b) + avg(c * c)) / 3 AS v, (avg(la) + avg(lb) + avg(lc)) / 3 AS k FROM l GROUP BY pix)
SELECT pix, n, {R('(v + 2 * k) / 3')} AS diffusion, {R('greatest(-k, 0.0e0)')} AS noise FROM s""")
def d27_diffusivity(spark, sf):
    return rounded(D.diffusivity(with_pixel(_steps(spark, sf), 2)))


@query(Q.D28)
def d28_residual_diffusivity(spark, sf):
    s = _steps(spark, sf)
    field = D.vector_field(s, 2, 0.5, 500.0, 10_000.0, 10_000.0).where("t_idx = 0")
    return rounded(D.diffusivity(D.residual_steps(s, field, 2, 500.0), axes=("vu", "vv")), 4)


@query(f"""{STEP_SQL}, {pix_sql(2)}, i AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t) AS i, row_number() OVER (PARTITION BY track_id ORDER BY t) - row_number() OVER (PARTITION BY track_id, pix ORDER BY t) AS run FROM pix)
SELECT a.pix, CAST(b.i - a.i AS INT) AS lag, {R('avg(power(b.mx - a.mx, 2) + power(b.my - a.my, 2) + power(b.mz - a.mz, 2))')} AS msd, count(*) AS n FROM i AS a JOIN i AS b ON a.track_id = b.track_id AND a.pix = b.pix AND a.run = b.run AND b.i - a.i IN (1, 2, 4) GROUP BY ALL""")
def d36_pixel_msd(spark, sf):
    return rounded(D.pixel_msd(_steps(spark, sf), 2))


@query(Q.D38)
def d38_flux(spark, sf):
    f = D.flux(D.vector_field(_steps(spark, sf), 4, 0.3, 500.0, 45.0, 15.0), 4, 500.0)
    return rounded(f.select("t_idx", "pix", "net_flux", "throughput"), 3)


@query(Q.I08)
def i08_smooth_field(spark, sf):
    f = D.pixel_stats(_angles(spark, sf), 4, "mean_fluo").select("t", "pix", F.col("mean").alias("value"))
    return rounded(D.smooth_field(f, 4, 0.2))


@query(Q.I09)
def i09_laplacian_smooth(spark, sf):
    f = D.pixel_stats(_angles(spark, sf), 4, "mean_fluo").select("t", "pix", F.col("mean").alias("value"))
    return rounded(D.laplacian_smooth(f, 4, 0.5, 5))


@query(f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, m AS (SELECT t, pix, avg(mean_fluo) AS mean FROM pix GROUP BY ALL) SELECT p.track_id, p.t, {R('m.mean')} AS mean FROM pix AS p JOIN m ON m.t = p.t AND m.pix = p.pix""")
def i11_sample_field(spark, sf):
    a = _angles(spark, sf)
    return rounded(D.sample_field(a, D.pixel_stats(a, 4, "mean_fluo").select("t", "pix", "mean"), 4).select("track_id", "t", "mean"))


@query(f"""{WITH_SPHERE}, {ANGLES}, g AS (SELECT t, CAST(round_even(theta / pi() * 18, 0) AS INT) AS i, CAST(round_even(phi / (2 * pi()) * 36, 0) AS INT) % 36 AS j, mean_fluo AS v FROM a)
SELECT t, i, CAST(CASE WHEN i IN (0, 18) THEN 0 ELSE j END AS INT) AS j, count(*) AS n, {R('sum(v)')} AS sum, {R('avg(v)')} AS mean, {R('max(v)')} AS max FROM g GROUP BY ALL""")
def d56_grid_stats(spark, sf):
    return rounded(U.grid_stats(_angles(spark, sf), "mean_fluo"))


@query(Q.I10)
def i10_smooth_grid(spark, sf):
    return rounded(U.smooth_grid(U.grid_stats(_angles(spark, sf), "mean_fluo"), 1.0))


@query(f"""{WITH_SPHERE}, {ANGLES}, p AS (SELECT mean_fluo, 2 * sin(theta / 2) * cos(phi) AS px, 2 * sin(theta / 2) * sin(phi) AS py FROM a)
SELECT CAST(least(floor((px + sqrt(2)) / (2 * sqrt(2)) * 16), 15) AS INT) AS ix, CAST(least(floor((py + sqrt(2)) / (2 * sqrt(2)) * 16), 15) AS INT) AS iy, round(avg(mean_fluo), 9) + 0.0e0 AS mean, count(*) AS n FROM p WHERE px * px + py * py <= 2 GROUP BY ALL""")
def d47_map_raster(spark, sf):
    return rounded(U.map_raster(_angles(spark, sf), "mean_fluo", 16), 9)


@query()
def d30_sphere_fit(spark, sf):
    return rounded(U.fit_sphere(tracks(spark, sf), rounds=4), 3)


@query(Q.D31)
def d31_algebraic_sphere(spark, sf):
    return rounded(U.algebraic_sphere(tracks(spark, sf)), 3)


@query()
def d32_bounded_fit(spark, sf):
    return rounded(U.fit_sphere(tracks(spark, sf), rounds=4, huber=3.0, bounds={"radius": (400.0, 600.0)}), 3)


@query()
def d33_harmonic_surface(spark, sf):
    a = _angles(spark, sf)
    out = U.evaluate_harmonics(a, U.harmonic_surface(a, 2, 2), 2)
    return rounded(out.select("track_id", "t", "r_fit"), 3)


@query(f"{COMPONENTS} SELECT t, track_id, CASE WHEN size >= 4 THEN component ELSE -1 END AS component FROM k")
def i01_components(spark, sf):
    return K.near_components(_units(spark, sf), 0.3, 4)


@query(f"""{COMPONENTS}, m AS (SELECT u.t, k.component, u.ux, u.uy, u.uz, u.mean_fluo FROM k JOIN u ON u.t = k.t AND u.track_id = k.track_id WHERE k.size >= 4)
SELECT t, component AS cluster_id, count(*) AS size, {R('CAST(sum(CAST(mean_fluo AS DECIMAL(28, 10))) AS DOUBLE) / count(*)')} AS fluo_mean, {R('sum(ux) / sqrt(power(sum(ux), 2) + power(sum(uy), 2) + power(sum(uz), 2))')} AS cx FROM m GROUP BY ALL""")
def d34_clusters(spark, sf):
    _, stats = K.find_clusters(_units(spark, sf), 0.3, 4, near=False)
    return rounded(stats.select("t", "cluster_id", "size", "fluo_mean", "cx"))


@query(f"""{COMPONENTS}, m AS (SELECT t, track_id, component AS c FROM k WHERE size >= 4), n AS (SELECT t, c, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT b.t, a.c AS prev_id, b.c AS curr_id, count(*) AS shared FROM m AS a JOIN m AS b ON b.t = a.t + 1 AND a.track_id = b.track_id GROUP BY ALL)
SELECT s.t, s.prev_id, s.curr_id, s.shared, {R('s.shared / least(p.n, q.n)')} AS overlap, {R('s.shared / (p.n + q.n - s.shared)')} AS jaccard, {R('s.shared / greatest(p.n, q.n)')} AS coverage
FROM s JOIN n AS p ON p.t = s.t - 1 AND p.c = s.prev_id JOIN n AS q ON q.t = s.t AND q.c = s.curr_id""")
def g03_cluster_overlap(spark, sf):
    members, _ = K.find_clusters(_units(spark, sf), 0.3, 4, near=False)
    return rounded(K.cluster_pair_scores(members))


@query(Q.C20)
def c20_gated_scores(spark, sf):
    _, stats = K.find_clusters(_units(spark, sf), 0.3, 4)
    return rounded(K.gated_scores(stats, 0.2))


@query(Q.G04)
def g04_geometric_overlap(spark, sf):
    """Overlap of all clusters of consecutive frames that have near members."""
    members, _ = K.find_clusters(_units(spark, sf), 0.3, 4, near=False)
    place = materialize(members.join(_units(spark, sf).select("track_id", "t", "ux", "uy", "uz"), ["track_id", "t"]), "members")
    pairs = K.near_clusters(place.withColumn("t", F.col("t") + 1), place, 0.1, "t")
    pairs = pairs.select((F.col("t") - 1).alias("ta"), F.col("cluster_id").alias("a"), F.col("t").alias("tb"), F.col("n_cluster_id").alias("b"))
    return rounded(K.geometric_overlap(pairs, place, 0.1).select(F.col("tb").alias("t"), F.col("a").alias("prev_id"), F.col("b").alias("curr_id"), "sim"))


@query(Q.A07)
def a07_augment_tracks(spark, sf):
    """Density and mean fluorescence of the field at every cell's pixel and nearest window."""
    field = D.density_field(_steps(spark, sf), 4, 0.2, 45.0, 15.0)
    points = _angles(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return rounded(A.augment_tracks(points, field, 4, 15.0, t_min=0.75).select("track_id", "t", "density", "fluo"))


def _found(units, angle: float):
    members, stats = K.find_clusters(units, angle, 4)
    return materialize(members, "members"), materialize(stats, "stats")


@query()
def i02_track_clusters(spark, sf):
    """Clusters linked with motion prediction."""
    units = _units(spark, sf)
    members, stats = _found(units, 0.3)
    return K.track_clusters(units, members, stats, 0.1)[0]


@query()
def i02_track_merges(spark, sf):
    """Merges of clusters where all cells drift towards one meridian."""
    k = _angles(spark, sf).withColumn("phi", F.col("phi") * (1 - F.col("t") / 150.0))
    sin = F.sin("theta")
    units = k.select("track_id", "t", "mean_fluo", (sin * F.cos("phi")).alias("ux"), (sin * F.sin("phi")).alias("uy"), F.cos("theta").alias("uz"))
    units = materialize(units, "units")
    members, stats = _found(units, 0.2)
    return K.track_clusters(units, members, stats, 0.15, least=0.2)[1]


def _stitched(spark, sf):
    units = materialize(gapped(_units(spark, sf)), "units")
    members, stats = _found(units, 0.2)
    chains, _ = K.track_clusters(units, members, stats, 0.1)
    place = members.join(units.select("track_id", "t", "ux", "uy", "uz"), ["track_id", "t"])
    return K.stitch_chains(chains.join(stats, ["t", "cluster_id"]), place, 0.1, gap_max=6)


@query()
def i03_stitch_chains(spark, sf):
    """Chains of clusters joined over gaps by overlap, features and motion."""
    return _stitched(spark, sf)[0]


@query()
def i03_stitch_log(spark, sf):
    return rounded(_stitched(spark, sf)[1])


@query()
def i02_link_clusters(spark, sf):
    members, stats = K.find_clusters(_units(spark, sf), 0.3, 4, near=False)
    named, _ = K.link_clusters(K.cluster_pair_scores(members), stats)
    return named


@query()
def d35_chain_stats(spark, sf):
    members, stats = K.find_clusters(_units(spark, sf), 0.3, 4, near=False)
    named, _ = K.link_clusters(K.cluster_pair_scores(members), stats)
    return rounded(K.chain_stats(named, stats).select("t", "cluster_id", "chain_id", "start_t", "end_t", "duration", "mean_size", "max_size", "n_obs"))


def gapped(df):
    """``df`` with five frames missing after every twenty; no row goes."""
    return df.withColumn("t", (F.col("t") + 5 * F.floor(F.col("t") / 20)).cast("int"))


def broken_tracks(spark, sf):
    """All rows of the tracks, with gaps, and a track of its own between two gaps."""
    k = gapped(tracks(spark, sf))
    return k.withColumn("track_id", F.col("track_id") * 100 + F.floor(F.col("t") / 25))


@query()
def i03_stitch(spark, sf):
    """Tracks cut at gaps, joined again."""
    k = broken_tracks(spark, sf)
    return K.stitch_segments(L.track_ends(k), 6, 60.0)


@query()
def i05_link_optimal(spark, sf):
    """Cells of consecutive frames paired for the smallest total distance under a gate."""
    k = tracks(spark, sf).select("t", "track_id", "x", "y", "z")
    later = k.withColumn("t", F.col("t") - 1)
    near = near_rows(k, later, 15.0, span=16)
    # nearness, so that a pair is always better than none
    pairs = near.select(F.struct("t", "track_id").alias("left"), F.struct("t", "n_track_id").alias("right"), (16.0 - F.col("distance")).alias("score"))
    pairs = pairs.select(F.concat_ws(":", "left.t", "left.track_id").alias("left"), F.concat_ws(":", "right.t", "right.n_track_id").alias("right"), "score", F.expr("left.t * 1e6 + left.track_id").alias("place"), "left.t")
    out = K.optimal_assignment(pairs, "left", "right", "score", "place", group="t")
    name = lambda c, i: F.split(c, ":")[i].cast("long")
    return out.select(name("left", 0).alias("t"), name("left", 1).alias("track_id"), name("right", 1).alias("next_id"), F.round("score", 6).alias("score"))


@query()
def i05_link_frames(spark, sf):
    return L.link_frames(tracks(spark, sf).withColumnRenamed("track_id", "id"), 15.0)


@query()
def i06_close_gaps(spark, sf):
    k = broken_tracks(spark, sf)
    return rounded(L.close_gaps(k, 7, 60.0))


@query(Q.I07)
def i07_fuse_duplicates(spark, sf):
    k = tracks(spark, sf)
    twin = k.where("track_id % 5 = 0").withColumns({"track_id": F.col("track_id") + 1_000_000, "x": F.col("x") + 1.0})
    return rounded(L.fuse_duplicates(k.unionByName(twin), 3.0).select("track_id", "t", "x", "n_fused"))


@query(f"""{RECURSIVE}, e AS (SELECT a.t, a.track_id AS x, b.track_id AS y, power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2) AS d FROM u AS a JOIN u AS b ON a.t = b.t AND a.track_id <> b.track_id
  WHERE sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) <= 2 * sin(0.15e0)),
c AS (SELECT t, x FROM e GROUP BY t, x HAVING count(*) >= 3), i AS (SELECT e.t, e.x, e.y FROM e JOIN c AS p ON p.t = e.t AND p.x = e.x JOIN c AS q ON q.t = e.t AND q.x = e.y),
r AS (SELECT t, x, x AS y FROM c UNION SELECT r.t, r.x, i.y FROM r JOIN i ON i.t = r.t AND i.x = r.y), k AS (SELECT t, x, min(y) AS m FROM r GROUP BY t, x),
b AS (SELECT e.t, e.x, k.m, row_number() OVER (PARTITION BY e.t, e.x ORDER BY e.d, e.y) AS r FROM e JOIN k ON k.t = e.t AND k.x = e.y WHERE (e.t, e.x) NOT IN (SELECT (t, x) FROM c))
SELECT u.t, u.track_id, coalesce(k.m, b.m, -1) AS cluster FROM u LEFT JOIN k ON k.t = u.t AND k.x = u.track_id LEFT JOIN b ON b.t = u.t AND b.x = u.track_id AND b.r = 1""")
def d46_dbscan(spark, sf):
    return K.dbscan(_units(spark, sf), 0.3, 4)


@query(f"""{WITH_VOXELS} SELECT t, label, channel, {R('avg(intensity)')} AS mean_fluo FROM voxels WHERE label > 0 GROUP BY ALL""")
def d09_mean_intensity(spark, sf):
    return rounded(V.mean_intensity(voxels(spark, sf)))


@query(f"""{Q.EIGEN}, f AS (SELECT t, label, count(*) AS volume, {R('avg(x)')} AS cx, max(z) - min(z) + 1 AS bbox_z, {R('count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1)) * 1000')} AS extent,
{R('avg(intensity)')} AS mean_intensity, {R('min(intensity)')} AS min_intensity, {R('max(intensity)')} AS max_intensity FROM voxels WHERE label > 0 GROUP BY ALL)
SELECT f.*, {R('CASE WHEN ev.e3 > 1e-9 THEN sqrt(ev.e1 / ev.e3) END')} AS elongation FROM f JOIN ev ON ev.t = f.t AND ev.label = f.label""")
def d10_region_features(spark, sf):
    f = V.region_features(voxels(spark, sf))
    return rounded(f.select("t", "label", "volume", "cx", "bbox_z", (F.col("extent") * 1000).alias("extent"), "mean_intensity", "min_intensity", "max_intensity", "elongation"))


@query(f"{WITH_VOXELS} SELECT t, label, {R('count(*) * 0.5e0')} AS volume FROM voxels WHERE label > 0 GROUP BY ALL HAVING count(*) * 0.5e0 > 24")
def d11_volume_filter(spark, sf):
    return rounded(V.volume_filter(voxels(spark, sf), 24.0, 0.5))


@query(Q.D12)
def d12_shape_filter(spark, sf):
    return rounded(V.shape_filter(voxels(spark, sf)))


@query(f"""{WITH_VOXELS}, f AS (SELECT DISTINCT t, label, y, x FROM voxels WHERE label > 0), a AS (SELECT t, label, count(*) AS n FROM f GROUP BY ALL), z AS (SELECT t, label, avg(z) AS z FROM voxels GROUP BY ALL),
o AS (SELECT p.t, p.label, q.label AS other, count(*) AS n FROM f AS p JOIN f AS q ON p.t = q.t AND p.y = q.y AND p.x = q.x AND p.label <> q.label GROUP BY ALL)
SELECT DISTINCT o.t, o.label FROM o JOIN a ON a.t = o.t AND a.label = o.label JOIN z AS zp ON zp.t = o.t AND zp.label = o.label JOIN z AS zq ON zq.t = o.t AND zq.label = o.other WHERE o.n / a.n >= 0.05e0 AND zq.z - zp.z < 0 AND zq.z - zp.z >= -30""")
def c19_shadowed(spark, sf):
    return V.shadowed_labels(voxels(spark, sf), 0.05)


@query()
def d14_mask_quality(spark, sf):
    """All four filters in turn."""
    return V.mask_quality(voxels(spark, sf), 30, 0.05, 3.0, 5.0)


@query(f"""{WITH_VOXELS}, v AS (SELECT DISTINCT t, z, y, x, label FROM voxels WHERE channel = 1), w AS (SELECT DISTINCT t, z, y, x, label FROM voxels WHERE channel <> 1)
SELECT v.label, w.label AS other_label, count(*) AS n FROM v JOIN w USING (t, z, y, x) GROUP BY ALL""")
def c18_label_overlap(spark, sf):
    v = voxels(spark, sf)
    return N.label_overlap(v.where("channel = 1"), v.where("channel <> 1"))


@query(f"""{WITH_VOXELS}, v AS (SELECT DISTINCT t, z, y, x, label FROM voxels WHERE channel = 1), w AS (SELECT DISTINCT t, z, y, x, label FROM voxels WHERE channel <> 1),
o AS (SELECT v.label, w.label AS k, count(*) AS n FROM v JOIN w USING (t, z, y, x) GROUP BY ALL), f AS (SELECT label, avg(intensity) AS f FROM voxels GROUP BY label)
SELECT o.label, {R('sum(o.n * f.f) / sum(o.n)')} AS fluo FROM o JOIN f ON f.label = o.k GROUP BY o.label""")
def c24_transfer(spark, sf):
    v = voxels(spark, sf)
    values = v.groupBy("label").agg(F.avg("intensity").alias("mean_fluo"))
    return rounded(V.transfer_fluorescence(v.where("channel = 1"), v.where("channel <> 1"), values))


@query(f"""{WITH_VOXELS}, m AS (SELECT DISTINCT t, z, y, x, label FROM voxels), b AS (SELECT DISTINCT t, z, y, x, label AS k FROM voxels WHERE intensity > 70000),
o AS (SELECT m.label, count(*) AS n FROM m JOIN b USING (t, z, y, x) GROUP BY m.label), s AS (SELECT label, count(*) AS s FROM m GROUP BY label), v AS (SELECT label, avg(intensity) AS f FROM voxels GROUP BY label)
SELECT label, {R('f')} AS mean_fluo FROM v WHERE label NOT IN (SELECT o.label FROM o JOIN s ON s.label = o.label WHERE o.n / s.s > 0.35e0) ORDER BY f DESC, label LIMIT 20""")
def c25_brightest_uncovered(spark, sf):
    v = voxels(spark, sf)
    values = v.groupBy("label").agg(F.avg("intensity").alias("mean_fluo"))
    return rounded(V.brightest_uncovered(v.where("intensity > 70000"), v, values, 20, 0.35))


@query(f"{WITH_VOXELS} SELECT t, channel, y, x, {R('max(intensity)')} AS intensity FROM voxels GROUP BY ALL")
def d50_max_projection(spark, sf):
    return rounded(V.max_projection(voxels(spark, sf)))


@query(f"""{WITH_VOXELS}, n AS (SELECT t, y, label, count(*) AS n FROM voxels GROUP BY ALL) SELECT t, y, label FROM (SELECT *, row_number() OVER (PARTITION BY t, y ORDER BY n DESC, label) AS r FROM n) AS q WHERE r = 1""")
def d51_dominant_label(spark, sf):
    return V.dominant_label(voxels(spark, sf), ["t", "y"])


@query(f"{WITH_VOXELS} SELECT t, z, y, x, label, channel FROM voxels WHERE label > 0 AND intensity > 50000")
def a10_foreground(spark, sf):
    return V.foreground(voxels(spark, sf).where("intensity > 50000")).select("t", "z", "y", "x", "label", "channel")


@query()
def f04_weighted_sample(spark, sf):
    return S.weighted_sample(tracks(spark, sf).select("track_id", "t", "mean_fluo"), 100, F.col("mean_fluo") ** 6, ["track_id", "t"])


@query()
def d43_bootstrap(spark, sf):
    return rounded(S.bootstrap_mean(tracks(spark, sf), "mean_fluo", "track_id", 100, group=("track_class",)))


@query()
def d43_bootstrap_band(spark, sf):
    return rounded(S.bootstrap_band(tracks(spark, sf), "mean_fluo", "track_id", 11, 50))


def _vectors(spark, sf, name: str = "label"):
    """Embeddings with one column per component, all of them, and the columns' names."""
    e = table(spark, sf, "embeddings")
    n = e.select(F.max(F.size("embedding")).alias("n")).first().n
    names = [f"f{i}" for i in range(n)]
    return e.select("vec_id", F.col("label").cast("double").alias(name), *(F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(names))), names


@query()
def d44_mixture(spark, sf):
    """Two kinds of regions by volume and intensity."""
    out = S.mixture(V.region_features(voxels(spark, sf)).select("t", "label", F.col("volume").cast("double").alias("volume"), "mean_intensity"), ["volume", "mean_intensity"])
    return out.select("t", "label", "component", F.round(F.col("probability")[0], 6).alias("p_first"), F.round("log_likelihood", 3).alias("log_likelihood"))


@query()
def d45_forest(spark, sf):
    e, names = _vectors(spark, sf)
    fit = e.where(F.pmod(F.xxhash64("vec_id"), F.lit(5)) > 0)
    return S.forest(fit, e, names, "label").select("vec_id", "predicted", F.transform("log_p", lambda p: F.round(p, 6)).alias("log_p"))


@query()
def d45_forest_accuracy(spark, sf):
    e, names = _vectors(spark, sf)
    return rounded(S.held_out_accuracy(e, names, "label", "vec_id"))


@query("""WITH o AS (SELECT o_orderpriority AS g, o_custkey AS p, CAST(o_totalprice AS DOUBLE) AS v FROM orders), b AS (SELECT g, var_samp(v) AS vb, count(v) AS n FROM o GROUP BY g),
t AS (SELECT g, p, max(v) - min(v) AS d FROM o GROUP BY g, p HAVING count(*) = 2), q AS (SELECT g, sum(d * d) / count(*) AS vp, count(*) AS k FROM t GROUP BY g)
SELECT b.g AS o_orderpriority, round(b.vb / 1e6, 4) + 0.0e0 AS var_base, round(q.vp / 1e6, 4) + 0.0e0 AS var_pair, b.n, coalesce(q.k, 0) AS n_pairs FROM b LEFT JOIN q ON q.g = b.g""")
def d53_paired_variances(spark, sf):
    """Orders of one priority; two orders of one customer are a pair."""
    o = table(spark, sf, "orders").withColumn("v", F.col("o_totalprice").cast("double"))
    out = S.paired_variances(o, ["o_orderpriority"], "v", "o_custkey")
    return rounded(out.withColumns({"var_base": F.col("var_base") / 1e6, "var_pair": F.col("var_pair") / 1e6}), 4)


@query("""WITH o AS (SELECT o_orderpriority AS m, o_orderstatus AS k, o_custkey % 3 AS d, CAST(o_totalprice AS DOUBLE) AS v FROM orders), x AS (SELECT m, k, d, var_samp(v) AS s FROM o GROUP BY ALL HAVING var_samp(v) > 0),
e AS (SELECT m, k, count(*) / 2.0e0 * ln(2 * pi() * exp(1.0e0)) + sum(ln(s)) / 2 AS h FROM x GROUP BY ALL), r AS (SELECT m, avg(v) AS error FROM o GROUP BY m)
SELECT r.m AS o_orderpriority, round(max(h) FILTER (k = 'F'), 6) + 0.0e0 AS entropy_F, round(max(h) FILTER (k = 'O'), 6) + 0.0e0 AS entropy_O, round(max(h) FILTER (k = 'P'), 6) + 0.0e0 AS entropy_P, round(any_value(r.error), 2) + 0.0e0 AS error
FROM r LEFT JOIN e ON e.m = r.m GROUP BY r.m""")
def d58_entropy_by_class(spark, sf):
    """Three variances per priority (the medium) and status (the class), and the mean price as the error."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 3).alias("d"), F.col("o_totalprice").cast("double").alias("error"))
    v = o.groupBy("o_orderpriority", "o_orderstatus", "d").agg(F.var_samp("error").alias("var"))
    out = S.entropy_by_class(v, ["o_orderpriority"], "o_orderstatus", o)
    return rounded(out.withColumn("error", F.round("error", 2)))


@query("""SELECT c_custkey, CAST(CASE WHEN c_mktsegment LIKE 'A%' THEN 0 ELSE -1 END AS INT) AS flag FROM customer""")
def h02_channel_index(spark, sf):
    """A nuclear channel is found where the segment's name stands for one."""
    c = table(spark, sf, "customer")
    names = F.array(F.when(F.col("c_mktsegment").startswith("A"), "h2b-mCherry").otherwise("bf"), F.lit("GFP"))
    first, _ = A.channel_index(names)
    return c.select("c_custkey", F.coalesce(first, F.lit(-1)).cast("int").alias("flag"))


@query("SELECT event_id, printf('t%04d', event_id) AS k FROM events")
def h03_frame_key(spark, sf):
    """Keys of numbers with one to more than four digits."""
    return table(spark, sf, "events").select("event_id", A.frame_key(F.col("event_id")).alias("k"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS u FROM events), e AS (SELECT u AS a, u + 7 AS b FROM s UNION ALL SELECT u + 7, u FROM s),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT a AS node, min(b) AS component FROM r GROUP BY a""")
def i01_graph_components(spark, sf):
    """Components of a graph of user ids: each id is joined to the one seven above."""
    u = table(spark, sf, "events").select("user_id").distinct()
    return connected_components(u.select(F.col("user_id").alias("src"), (F.col("user_id") + 7).alias("dst")))


@query(Q.C11)
def c11_pixel_neighbors(spark, sf):
    """How many pixels lie about the pixel of each cell."""
    near = pixel_neighbors(spark, 4, 2 * math.pi / 18).groupBy("pix").agg(F.count("*").alias("n_near"))
    return with_pixel(_angles(spark, sf), 4).join(F.broadcast(near), "pix").select("track_id", "t", "n_near")
