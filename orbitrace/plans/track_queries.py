"""Window and sequence operators, statistics and joins over the tracks of ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrace.operators import lineage as L
from orbitrace.operators import msd as M
from orbitrace.operators import neighbors as N
from orbitrace.operators import stats as S
from orbitrace.operators import tracks as T
from orbitrace.operators.blocks import near_rows
from orbitrace.plans.geometry_queries import R
from orbitrace.plans.registry import query, rounded
from orbitrace.sources import tables as A
from orbitrace.sources.testviews import WITH_SPHERE, WITH_TRACKS, sphere, table, tracks

W = "WINDOW w AS (PARTITION BY track_id ORDER BY t)"
STEPS = f"""d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM tracks {W}),
s AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS step FROM d)"""


@query(f"{WITH_TRACKS}, {STEPS} SELECT track_id, t, {R('dx')} AS dx, {R('dy')} AS dy, {R('dz')} AS dz, {R('step')} AS step FROM s")
def e01_steps(spark, sf):
    return rounded(T.step_lengths(tracks(spark, sf)).select("track_id", "t", "dx", "dy", "dz", "step"))


@query(f"""{WITH_TRACKS}, {STEPS}, m AS (SELECT *, avg(step) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS mean_step FROM s),
f AS (SELECT *, coalesce(mean_step < 8, false) AS is_stationary FROM m)
SELECT track_id, t, {R('mean_step')} AS mean_step, is_stationary, count(*) OVER (PARTITION BY track_id) AS track_length,
  avg(CAST(is_stationary AS INT)) OVER (PARTITION BY track_id) > 0.3e0 AS mostly_stationary FROM f""")
def e02_preprocess(spark, sf):
    out = T.preprocess_tracks(tracks(spark, sf), 5, 8.0, stationary_share=0.3)
    return rounded(out.select("track_id", "t", "mean_step", "is_stationary", "track_length", "mostly_stationary"))


@query(f"""{WITH_TRACKS} SELECT track_id, t, {R('avg(x) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)')} AS x_mean,
  {R('avg(mean_fluo) OVER (PARTITION BY track_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)')} AS mean_fluo_mean FROM tracks""")
def e03_rolling_mean(spark, sf):
    return rounded(T.rolling_mean(tracks(spark, sf), ["x", "mean_fluo"], 6).select("track_id", "t", "x_mean", "mean_fluo_mean"))


@query(f"""{WITH_TRACKS}, p AS (SELECT track_class AS well, t, avg(x) AS center_x, avg(z) AS radius FROM tracks GROUP BY track_class, t),
m AS (SELECT *, avg(center_x) OVER v AS xs, avg(radius) OVER v AS rs FROM p WINDOW v AS (PARTITION BY well ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT well, t, {R('xs')} AS center_x_smooth, {R('rs')} AS radius_smooth,
  abs(center_x - xs) > 1.9e0 * stddev_pop(center_x - xs) OVER (PARTITION BY well) OR abs(radius - rs) > 1.9e0 * stddev_pop(radius - rs) OVER (PARTITION BY well) AS is_outlier FROM m""")
def e04_smooth_fits(spark, sf):
    fits = tracks(spark, sf).groupBy(F.col("track_class").alias("well"), "t").agg(F.avg("x").alias("center_x"), F.avg("z").alias("radius"))
    out = T.smooth_sphere(fits, 5, 1.9, ("center_x", "radius"))
    return rounded(out.select("well", "t", "center_x_smooth", "radius_smooth", "is_outlier"))


@query(f"""{WITH_TRACKS}, r AS (SELECT track_id, t, x, row_number() OVER w AS i, count(*) OVER (PARTITION BY track_id) AS n,
  lag(x, 2) OVER w AS a, lag(x) OVER w AS b, lead(x) OVER w AS c, lead(x, 2) OVER w AS d, lead(x, 3) OVER w AS e, lead(x, 4) OVER w AS f, lag(x, 3) OVER w AS g, lag(x, 4) OVER w AS h FROM tracks {W})
SELECT track_id, t, {R('''CASE WHEN n < 5 THEN x WHEN i = 1 THEN (31 * x + 9 * c - 3 * d - 5 * e + 3 * f) / 35 WHEN i = 2 THEN (9 * b + 13 * x + 12 * c + 6 * d - 5 * e) / 35
  WHEN i = n THEN (31 * x + 9 * b - 3 * a - 5 * g + 3 * h) / 35 WHEN i = n - 1 THEN (9 * c + 13 * x + 12 * b + 6 * a - 5 * g) / 35 ELSE (-3 * a + 12 * b + 17 * x + 12 * c - 3 * d) / 35 END''')} AS x_s FROM r""")
def e05_savgol(spark, sf):
    """Interior rows by the five-point quadratic; the two rows at each end by the fit of the end's five points."""
    return rounded(T.savgol(tracks(spark, sf), 5, 2, ("x",)).select("track_id", "t", "x_s"))


MSD_SQL = f"""i AS (SELECT track_id, t, x, y, z, CAST(row_number() OVER w AS INT) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n FROM tracks {W}),
w AS (SELECT i.*, CAST(s AS INT) AS start_idx FROM i, unnest(range(0, n - 20 + 1, 5)) AS u(s) WHERE i >= s AND i < s + 20)"""


@query(f"""{WITH_TRACKS}, {MSD_SQL}, m AS (SELECT a.track_id, a.start_idx, b.i - a.i AS tau,
  avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS msd, count(*) AS n_obs
  FROM w AS a JOIN w AS b ON a.track_id = b.track_id AND a.start_idx = b.start_idx AND b.i - a.i BETWEEN 1 AND 6 GROUP BY ALL)
SELECT track_id, start_idx, tau, {R('msd')} AS msd, n_obs FROM m""")
def e07_sliding_msd(spark, sf):
    return rounded(M.sliding_msd(tracks(spark, sf), 20, 5, 6))


@query(f"""{WITH_TRACKS}, {MSD_SQL}, m AS (SELECT a.track_id, a.start_idx, b.i - a.i AS tau,
  avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS msd
  FROM w AS a JOIN w AS b ON a.track_id = b.track_id AND a.start_idx = b.start_idx AND b.i - a.i BETWEEN 1 AND 6 GROUP BY ALL)
SELECT track_id, start_idx, round(regr_slope(ln(msd), ln(tau)), 5) + 0.0e0 AS alpha, round(regr_r2(ln(msd), ln(tau)), 5) + 0.0e0 AS r2 FROM m GROUP BY ALL""")
def e07_window_exponents(spark, sf):
    return rounded(M.window_exponents(M.sliding_msd(tracks(spark, sf), 20, 5, 6), (1, 6)), 5)


@query(f"""{WITH_TRACKS}, v AS (SELECT track_id, CAST(row_number() OVER w AS INT) - 1 AS i, count(*) OVER (PARTITION BY track_id) AS n,
    lead(x) OVER w - x AS a, lead(y) OVER w - y AS b, lead(z) OVER w - z AS c FROM tracks {W}),
q AS (SELECT *, lead(a) OVER w AS d, lead(b) OVER w AS e, lead(c) OVER w AS f FROM v WINDOW w AS (PARTITION BY track_id ORDER BY i)),
k AS (SELECT q.*, CAST(s AS INT) AS start_idx, i - s AS k FROM q, unnest(range(0, n - 20, 5)) AS u(s) WHERE i >= s AND i < s + 19)
SELECT track_id, start_idx, {R('sum(a*d + b*e + c*f) FILTER (k < 18) / sum(a*a + b*b + c*c)')} AS c1,
  {R('avg((a*d + b*e + c*f) / sqrt((a*a + b*b + c*c) * (d*d + e*e + f*f))) FILTER (k < 18)')} AS mean_cos FROM k GROUP BY ALL""")
def e08_persistence(spark, sf):
    return rounded(M.sliding_persistence(tracks(spark, sf), 20, 5))


@query(f"""{WITH_TRACKS}, {MSD_SQL}, m AS (SELECT a.track_id, a.start_idx, b.i - a.i AS tau,
  avg((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) AS msd
  FROM w AS a JOIN w AS b ON a.track_id = b.track_id AND a.start_idx = b.start_idx AND b.i - a.i BETWEEN 1 AND 6 GROUP BY ALL),
f AS (SELECT track_id, start_idx + 10 AS i, regr_slope(ln(msd), ln(tau)) AS alpha FROM m GROUP BY ALL),
j AS (SELECT i.track_id, i.t, f.alpha, CASE WHEN f.alpha IS NOT NULL THEN i.t END AS ta FROM i LEFT JOIN f ON i.track_id = f.track_id AND i.i = f.i),
g AS (SELECT track_id, t, last_value(ta IGNORE NULLS) OVER b AS t0, last_value(alpha IGNORE NULLS) OVER b AS a0, first_value(ta IGNORE NULLS) OVER c AS t1,
  first_value(alpha IGNORE NULLS) OVER c AS a1 FROM j
  WINDOW b AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, t, round(CASE WHEN t0 IS NULL THEN a1 WHEN t1 IS NULL OR t0 = t1 THEN a0 ELSE a0 + (a1 - a0) * (t - t0) / (t1 - t0) END, 5) + 0.0e0 AS alpha FROM g""")
def e09_alpha_at_rows(spark, sf):
    k = tracks(spark, sf)
    return rounded(M.alpha_at_rows(k, M.window_exponents(M.sliding_msd(k, 20, 5, 6), (1, 6)), 20), 5)


@query(f"""{WITH_TRACKS}, {STEPS}, p AS (SELECT track_id, t, sum(step) OVER v AS path, count(step) OVER v AS k,
  sqrt(power(lead(x, 2) OVER w - lag(x, 2) OVER w, 2) + power(lead(y, 2) OVER w - lag(y, 2) OVER w, 2) + power(lead(z, 2) OVER w - lag(z, 2) OVER w, 2)) AS net
  FROM s WINDOW w AS (PARTITION BY track_id ORDER BY t), v AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
SELECT track_id, t, {R('CASE WHEN k = 4 THEN path / 4 END')} AS path_speed, {R('net / 4')} AS net_speed, {R('CASE WHEN k = 4 THEN net / path END')} AS vi FROM p""")
def e10_path_and_net(spark, sf):
    return rounded(T.path_and_net_speed(tracks(spark, sf), 5).select("track_id", "t", "path_speed", "net_speed", "vi"))


@query(f"""{WITH_TRACKS}, p AS (SELECT track_id, CAST(s AS INT) AS t0, count(*) AS n FROM tracks, unnest(range(0, t + 1, 10)) AS u(s) WHERE t < s + 20 GROUP BY ALL)
SELECT track_id, t0, n AS n_rows, track_id * 16777216 + t0 AS tracklet_id FROM p WHERE n = 20""")
def e11_tracklets(spark, sf):
    out = T.tracklets(tracks(spark, sf), 20, 10)
    return out.groupBy("track_id", "t0", "tracklet_id").agg(F.count("*").alias("n_rows")).select("track_id", "t0", "n_rows", "tracklet_id")


@query(f"{WITH_TRACKS} SELECT track_id, t, {R('x - first_value(x) OVER w')} AS x_rel, {R('z - first_value(z) OVER w')} AS z_rel FROM tracks {W}")
def e12_from_origin(spark, sf):
    return rounded(T.from_origin(tracks(spark, sf), ("x", "z")).select("track_id", "t", "x_rel", "z_rel"))


@query(f"""{WITH_TRACKS}, r AS (SELECT track_id, t, row_number() OVER w <= 3 AS is_head, row_number() OVER (PARTITION BY track_id ORDER BY t DESC) <= 3 AS is_tail FROM tracks {W})
SELECT * FROM r WHERE is_head OR is_tail""")
def e13_head_tail(spark, sf):
    return T.head_tail(tracks(spark, sf), 3).select("track_id", "t", "is_head", "is_tail")


@query(f"""{WITH_TRACKS}, {STEPS}, f AS (SELECT track_id, t, coalesce(dx, lead(dx) OVER w) AS vx, coalesce(dy, lead(dy) OVER w) AS vy, coalesce(dz, lead(dz) OVER w) AS vz FROM s {W})
SELECT track_id, t, {R('vx')} AS vx, {R('sqrt(vx*vx + vy*vy + vz*vz)')} AS speed FROM f""")
def e14_unit_velocity(spark, sf):
    return rounded(T.unit_step_velocity(tracks(spark, sf)).select("track_id", "t", "vx", "speed"))


@query(f"""{WITH_SPHERE}, d AS (SELECT track_id, t, x, y, z, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, z - lag(z) OVER w AS dz FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t)),
v AS (SELECT track_id, t, x, y, z, coalesce(dx, lead(dx) OVER w) AS vx, coalesce(dy, lead(dy) OVER w) AS vy, coalesce(dz, lead(dz) OVER w) AS vz FROM d WINDOW w AS (PARTITION BY track_id ORDER BY t)),
c AS (SELECT v.*, v.x - s.center_x_smooth AS a, v.y - s.center_y_smooth AS b, v.z - s.center_z_smooth AS c FROM v JOIN sphere AS s ON s.t = v.t),
n AS (SELECT *, (vx * a + vy * b + vz * c) / (a * a + b * b + c * c) AS k FROM c)
SELECT track_id, t, {R('vx - k * a')} AS vx, {R('vz - k * c')} AS vz, {R('sqrt(power(vx - k * a, 2) + power(vy - k * b, 2) + power(vz - k * c, 2))')} AS speed FROM n""")
def e14_surface_velocity(spark, sf):
    """Velocities in the surface of the fitted sphere."""
    k = tracks(spark, sf).join(sphere(spark, sf), "t")
    out = T.unit_step_velocity(k, ("center_x_smooth", "center_y_smooth", "center_z_smooth"))
    return rounded(out.select("track_id", "t", "vx", "vz", "speed"))


@query(f"""{WITH_TRACKS}, s AS (SELECT track_id, max(t) AS last FROM tracks GROUP BY track_id), g AS (SELECT track_id, k * 0.75e0 AS tn FROM s, unnest(range(0, CAST(floor(last / 0.75e0 + 1e-9) AS INT) + 1)) AS u(k))
SELECT g.track_id, {R('g.tn')} AS t, {R('a.mean_fluo + (g.tn - a.t) * (coalesce(b.mean_fluo, a.mean_fluo) - a.mean_fluo)')} AS mean_fluo
FROM g JOIN tracks AS a ON a.track_id = g.track_id AND a.t = CAST(floor(g.tn) AS INT) LEFT JOIN tracks AS b ON b.track_id = g.track_id AND b.t = CAST(floor(g.tn) AS INT) + 1""")
def e16_resample(spark, sf):
    """Fluorescence at steps of three quarters of a frame."""
    k = tracks(spark, sf).select("track_id", F.col("t").cast("double").alias("t"), "mean_fluo")
    return rounded(T.resample(k, ["mean_fluo"], 0.75))


@query(f"""{WITH_TRACKS}, k AS (SELECT track_id, t, CASE WHEN t % 4 = 0 THEN x END AS x FROM tracks),
g AS (SELECT track_id, t, x, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(x IGNORE NULLS) OVER b AS a0,
  first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER c AS t1, first_value(x IGNORE NULLS) OVER c AS a1 FROM k
  WINDOW b AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT track_id, t, {R('coalesce(x, CASE WHEN t1 IS NULL THEN a0 ELSE a0 + (a1 - a0) * (t - t0) / (t1 - t0) END)')} AS x_filled FROM g
WHERE t <= (SELECT max(t) FROM tracks AS m WHERE m.track_id = g.track_id)""")
def e15_fill_frames(spark, sf):
    """Every fourth frame known, the others interpolated."""
    sparse = tracks(spark, sf).select("track_id", "t", F.when(F.col("t") % 4 == 0, F.col("x")).alias("x"))
    return rounded(T.fill_frames(sparse, ["x"]).select("track_id", "t", "x_filled"))


@query(f"""{WITH_TRACKS}, k AS (SELECT track_id, t + t // 2 AS t, mean_fluo FROM tracks),
d AS (SELECT track_id, t, mean_fluo / coalesce(t - lag(t) OVER w, 1) AS s FROM k {W})
SELECT track_id, t, {R('sum(s) OVER (PARTITION BY track_id ORDER BY t ROWS UNBOUNDED PRECEDING)')} AS mean_fluo_drift FROM d""")
def e15_drift(spark, sf):
    """All rows, with a frame missing after every second one."""
    k = tracks(spark, sf).withColumn("t", F.expr("CAST(t + t div 2 AS int)"))
    return rounded(T.drift(k, ["mean_fluo"]).select("track_id", "t", "mean_fluo_drift"))


@query(f"""{WITH_TRACKS}, k AS (SELECT CAST(o AS INT) AS o, exp(-0.5e0 * o * o) / (SELECT sum(exp(-0.5e0 * o * o)) FROM unnest(range(-4, 5)) AS q(o)) AS w FROM unnest(range(-4, 5)) AS q(o)),
n AS (SELECT track_id, t, mean_fluo, max(t) OVER (PARTITION BY track_id) AS last FROM tracks)
SELECT n.track_id, n.t, {R('sum(k.w * m.mean_fluo)')} AS mean_fluo_smooth FROM n CROSS JOIN k
JOIN n AS m ON m.track_id = n.track_id AND m.t = least(greatest(n.t + k.o, 0), n.last) GROUP BY ALL""")
def e16_gaussian_smooth(spark, sf):
    return rounded(T.gaussian_smooth(tracks(spark, sf), "mean_fluo", 1.0).select("track_id", "t", "mean_fluo_smooth"))


@query(f"""{WITH_TRACKS}, k AS (SELECT track_id, t + t // 6 AS t FROM tracks), j AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1 THEN 1 ELSE 0 END AS j FROM k {W})
SELECT track_id, t, CAST(sum(j) OVER (PARTITION BY track_id ORDER BY t) AS BIGINT) AS segment FROM j""")
def e18_islands(spark, sf):
    """All rows, with a frame missing after every sixth one."""
    return T.islands(tracks(spark, sf).withColumn("t", F.expr("CAST(t + t div 6 AS int)"))).select("track_id", "t", "segment")


@query(f"{WITH_TRACKS}, s AS (SELECT *, min(t) OVER (PARTITION BY track_id) AS t_start FROM tracks) SELECT track_id, t, t_start, {R('x')} AS x FROM s WHERE t = greatest(t_start, 12)")
def e19_appearance(spark, sf):
    return rounded(L.appearance(tracks(spark, sf), 12).select("track_id", "t", "t_start", "x"))


@query(f"""{WITH_TRACKS}, k AS (SELECT track_id, t, CASE WHEN track_id % 2 = 0 AND t >= 20 THEN t * 90.0e0 + 5000 ELSE t * 90.0e0 END AS tm FROM tracks)
SELECT track_id, t, {R('t * 90.0e0')} AS tm_fixed FROM k""")
def e20_repair_timestamps(spark, sf):
    """Times with a jump at frame 20 of every second track come back even."""
    tm = F.when((F.col("track_id") % 2 == 0) & (F.col("t") >= 20), F.col("t") * 90.0 + 5000).otherwise(F.col("t") * 90.0)
    return rounded(T.repair_timestamps(tracks(spark, sf).withColumn("tm", tm), "track_id", "t", "tm").select("track_id", "t", "tm_fixed"))


@query(f"""{WITH_TRACKS}, n AS (SELECT t, CAST(sum(CASE WHEN mean_fluo > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_bright FROM tracks GROUP BY t)
SELECT t, n_bright, {R('avg(n_bright) OVER (ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS rolling FROM n""")
def e24_bright_count(spark, sf):
    return rounded(S.fluorescent_count(tracks(spark, sf), 50.0, 10))


@query(f"""{WITH_TRACKS}, {STEPS}, p AS (SELECT track_id, t, sum(step) OVER v AS path, count(step) OVER v AS k, count(*) OVER (PARTITION BY track_id) AS n,
  sqrt(power(lead(x, 2) OVER w - lag(x, 2) OVER w, 2) + power(lead(y, 2) OVER w - lag(y, 2) OVER w, 2) + power(lead(z, 2) OVER w - lag(z, 2) OVER w, 2)) AS net
  FROM s WINDOW w AS (PARTITION BY track_id ORDER BY t), v AS (PARTITION BY track_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING))
SELECT track_id, t, {R('CASE WHEN k = 4 THEN path END')} AS contour, {R('net')} AS net, {R('CASE WHEN k = 4 THEN net / path END')} AS coherence FROM p WHERE n >= 5""")
def e26_coherence(spark, sf):
    return rounded(T.coherence(tracks(spark, sf), 5).select("track_id", "t", "contour", "net", "coherence"))


@query(f"""{WITH_TRACKS}, j AS (SELECT track_id, t, CASE WHEN abs(x - lag(x) OVER w) > 15 OR abs(y - lag(y) OVER w) > 15 THEN 1 ELSE 0 END AS j FROM tracks {W})
SELECT track_id, t, CAST(sum(j) OVER (PARTITION BY track_id ORDER BY t) AS BIGINT) AS piece FROM j""")
def e27_break_at_jumps(spark, sf):
    return T.break_at_jumps(tracks(spark, sf), 15.0).select("track_id", "t", "piece")


@query(f"""{WITH_TRACKS}, f AS (SELECT DISTINCT t FROM tracks), k AS (SELECT t, CAST(c AS INT) AS track_class FROM f, unnest([0, 1, 2]) AS u(c))
SELECT k.t, k.track_class, count(DISTINCT m.track_id) AS n FROM k LEFT JOIN tracks AS m ON m.t = k.t AND m.track_class = k.track_class GROUP BY ALL""")
def d03_cells_per_class(spark, sf):
    return S.cells_per_class(tracks(spark, sf))


@query(f"""{WITH_TRACKS}, a AS (SELECT track_id, avg(-abs(mean_fluo - 20)) AS l0, avg(-abs(mean_fluo - 50)) AS l1, avg(-abs(mean_fluo - 80)) AS l2 FROM tracks GROUP BY track_id)
SELECT track_id, {R('l0')} AS "track_logL0", {R('l1')} AS "track_logL1", {R('l2')} AS "track_logL2", CAST(CASE WHEN l0 >= l1 AND l0 >= l2 THEN 0 WHEN l1 >= l2 THEN 1 ELSE 2 END AS BIGINT) AS track_class FROM a""")
def d04_track_class(spark, sf):
    scored = tracks(spark, sf).withColumns({f"logL{k}": -F.abs(F.col("mean_fluo") - m) for k, m in enumerate((20, 50, 80))})
    return rounded(S.track_class(scored))


@query(f"{WITH_TRACKS} SELECT track_id, {R('avg(x)')} AS mean_x, {R('avg(mean_fluo)')} AS mean_mean_fluo, count(*) AS n FROM tracks GROUP BY track_id HAVING count(*) > 60")
def d05_track_means(spark, sf):
    return rounded(S.track_means(tracks(spark, sf), ["x", "mean_fluo"], 60))


@query(f"{WITH_TRACKS} SELECT track_id, min(t) AS first_t, max(t) AS last_t, count(DISTINCT t) AS n_frames FROM tracks GROUP BY track_id")
def d06_track_spans(spark, sf):
    return S.track_spans(tracks(spark, sf))


@query(f"{WITH_TRACKS} SELECT t, {R('avg(mean_fluo)')} AS mean, {R('quantile_cont(mean_fluo, 0.1)')} AS p_low, {R('quantile_cont(mean_fluo, 0.9)')} AS p_high, count(*) AS n FROM tracks GROUP BY t")
def d06_percentiles(spark, sf):
    return rounded(S.percentiles_by(tracks(spark, sf), "t", "mean_fluo"))


@query(f"""{WITH_TRACKS}, e AS (SELECT quantile_cont(mean_fluo, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM tracks),
b AS (SELECT x, CAST(greatest(len(list_filter(e, lambda q: q < mean_fluo)) - 1, 0) AS INT) AS bin FROM tracks, e)
SELECT bin, count(*) AS n, {R('median(x)')} AS median, {R('avg(x)')} AS mean FROM b GROUP BY bin""")
def d07_quantile_bins(spark, sf):
    return rounded(S.quantile_bins(tracks(spark, sf), "mean_fluo", 5, "x"))


@query(f"""{WITH_TRACKS} SELECT CAST(CASE WHEN t <= 20 THEN 0 WHEN t <= 40 THEN 1 ELSE 2 END AS INT) AS bin, count(*) AS n, {R('avg(mean_fluo)')} AS mean
FROM tracks WHERE t > 0 AND t <= 60 GROUP BY ALL""")
def d08_time_bins(spark, sf):
    return rounded(S.time_bins(tracks(spark, sf), "t", [0, 20, 40, 60], "mean_fluo"))


@query(f"""{WITH_TRACKS}, m AS (SELECT CAST(l AS DOUBLE) AS lag, a.track_id, power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS d2 FROM tracks AS a JOIN tracks AS b ON a.track_id = b.track_id,
  unnest([3.0e0, 6.0e0, 12.0e0]) AS u(l) WHERE (b.t - a.t) * 1.5e0 BETWEEN l * 0.9e0 AND l * 1.1e0 AND b.t > a.t)
SELECT track_id, lag, {R('avg(d2)')} AS msd, count(*) AS n_pairs FROM m GROUP BY ALL""")
def d37_msd(spark, sf):
    k = tracks(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return rounded(M.msd_by_lag(k, (3.0, 6.0, 12.0)))


@query(f"""{WITH_TRACKS}, m AS (SELECT CAST(l AS DOUBLE) AS lag, a.track_id, power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS d2 FROM tracks AS a JOIN tracks AS b ON a.track_id = b.track_id,
  unnest([3.0e0, 6.0e0, 12.0e0]) AS u(l) WHERE (b.t - a.t) * 1.5e0 BETWEEN l * 0.9e0 AND l * 1.1e0 AND b.t > a.t), g AS (SELECT track_id, lag, avg(d2) AS msd FROM m GROUP BY ALL HAVING count(*) >= 3)
SELECT track_id, round(regr_slope(ln(msd), ln(lag)), 5) + 0.0e0 AS alpha, count(*) AS n_lags FROM g GROUP BY track_id HAVING count(*) >= 2""")
def d37_exponents(spark, sf):
    k = tracks(spark, sf).withColumn("time_min", F.col("t") * 1.5)
    return rounded(M.msd_exponent(M.msd_by_lag(k, (3.0, 6.0, 12.0))), 5)


@query(f"""{WITH_TRACKS}, r AS (SELECT track_id, CAST(row_number() OVER w AS INT) AS i, mean_fluo - avg(mean_fluo) OVER p AS a, x - avg(x) OVER p AS b,
  stddev_pop(mean_fluo) OVER p AS sa, stddev_pop(x) OVER p AS sb FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY t), p AS (PARTITION BY track_id))
SELECT r.track_id, CAST(l AS INT) AS lag, {R('avg(r.a * q.b) / (max(r.sa) * max(r.sb))')} AS corr FROM r, unnest(range(-2, 3)) AS u(l), r AS q WHERE q.track_id = r.track_id AND q.i = r.i + l GROUP BY ALL""")
def d42_lead_lag(spark, sf):
    return rounded(M.lead_lag(tracks(spark, sf), "mean_fluo", "x", 2))


@query(f"""{WITH_TRACKS}, p AS (SELECT DISTINCT track_id, parent_track_id FROM tracks), f AS (SELECT c.parent_track_id AS id, min(k.t) AS t FROM p AS c JOIN tracks AS k ON k.track_id = c.track_id
  WHERE c.parent_track_id >= 0 AND c.parent_track_id IN (SELECT track_id FROM p) GROUP BY ALL), n AS (SELECT t, count(*) AS n FROM f GROUP BY t)
SELECT t, CAST(100 + sum(n) OVER (ORDER BY t) AS BIGINT) AS n_cells FROM n""")
def d49_divisions(spark, sf):
    return L.division_counts(tracks(spark, sf), 100)


@query(f"""{WITH_TRACKS}, r AS (SELECT track_id, t, mean_fluo, CAST(row_number() OVER w - 1 AS DOUBLE) AS i FROM tracks {W}),
f AS (SELECT track_id, regr_slope(mean_fluo, i) AS a, regr_intercept(mean_fluo, i) AS b FROM r GROUP BY track_id)
SELECT r.track_id, r.t, {R('f.a * r.i + f.b')} AS mean_fluo_trend FROM r JOIN f ON r.track_id = f.track_id""")
def d52_trend(spark, sf):
    return rounded(S.trend(tracks(spark, sf), "track_id", "t", "mean_fluo").select("track_id", "t", "mean_fluo_trend"))


@query(f"""{WITH_TRACKS}, d AS (SELECT track_id, mean_fluo, mean_fluo - lag(mean_fluo) OVER w AS d FROM tracks {W})
SELECT track_id, {R('var_samp(mean_fluo)')} AS var_base, {R('var_samp(d)')} AS var_seq, count(*) AS n FROM d GROUP BY track_id""")
def d53_variances(spark, sf):
    return rounded(S.group_variances(tracks(spark, sf), ["track_id"], "mean_fluo", "t"))


@query(f"""{WITH_TRACKS}, v AS (SELECT track_class, t, var_samp(mean_fluo) AS var FROM tracks GROUP BY ALL)
SELECT track_class, {R('count(*) / 2.0e0 * ln(2 * pi() * exp(1)) + sum(ln(var)) / 2')} AS entropy, count(*) AS k FROM v WHERE var > 0 GROUP BY track_class""")
def d58_gaussian_entropy(spark, sf):
    v = tracks(spark, sf).groupBy("track_class", "t").agg(F.var_samp("mean_fluo").alias("var"))
    return rounded(S.gaussian_entropy(v, ["track_class"]))


@query("SELECT o_orderkey, o_orderpriority, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INT) AS o_orderpriority_id FROM orders")
def d60_category_ids(spark, sf):
    return S.category_ids(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


@query(f"{WITH_TRACKS} SELECT track_id, t, rank FROM (SELECT track_id, t, CAST(row_number() OVER (PARTITION BY t ORDER BY mean_fluo DESC, track_id) AS INT) AS rank FROM tracks) AS q WHERE rank <= 5")
def f02_top_per_frame(spark, sf):
    return S.top_per_frame(tracks(spark, sf), "mean_fluo", 5).select("track_id", "t", "rank")


@query(f"""{WITH_TRACKS}, d AS (SELECT a.track_id, a.t, b.track_id AS n_track_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d
  FROM tracks AS a JOIN tracks AS b ON a.t = b.t) SELECT track_id, t, n_track_id, {R('d')} AS distance FROM d WHERE d <= 75""")
def c06_radius_pairs(spark, sf):
    k = tracks(spark, sf).select("track_id", "t", "x", "y", "z")
    # rounded as the SQL does; F.round goes by decimals, which costs more than the pair
    return near_rows(k, k, 75.0, span=8).select("track_id", "t", "n_track_id", (F.floor(F.col("distance") * 1e6 + 0.5) / 1e6).alias("distance"))


@query(f"""{WITH_TRACKS}, d AS (SELECT a.track_id, a.t, b.track_id AS n_track_id, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) AS d
  FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND a.track_id <> b.track_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY t, track_id ORDER BY d, n_track_id) AS INT) AS rank FROM d)
SELECT track_id, t, n_track_id, rank, {R('d')} AS distance FROM r WHERE rank <= 3""")
def c08_knn(spark, sf):
    k = tracks(spark, sf).select("track_id", "t", "x", "y", "z")
    return rounded(N.nearest(k, k, 3, 80.0, "track_id", include_self=False).select("track_id", "t", "n_track_id", "rank", "distance"))


@query(f"""{WITH_TRACKS}, d AS (SELECT a.track_id, a.t, b.track_id AS k, row_number() OVER (PARTITION BY a.t, a.track_id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), b.track_id) AS r
  FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND b.track_class = 1 WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2) <= 8100)
SELECT a.track_id, a.t, coalesce(d.k, -1) AS "nearest_track_id" FROM tracks AS a LEFT JOIN d ON a.t = d.t AND a.track_id = d.track_id AND d.r = 1""")
def c10_nearest_within(spark, sf):
    k = tracks(spark, sf)
    out = N.nearest_within(k.select("track_id", "t", "x", "y", "z"), k.where("track_class = 1").select("track_id", "t", "x", "y", "z"), 90.0, "track_id", "track_id")
    return out.select("track_id", "t", "nearest_track_id")


@query(f"""{WITH_TRACKS} SELECT k.track_id, k.t, CAST(i AS INT) AS t_idx FROM tracks AS k, unnest(range(0, 20)) AS u(i) WHERE abs(k.t * 1.5e0 - i * 6) <= 10""")
def c12_windows(spark, sf):
    k = tracks(spark, sf).withColumn("m", F.col("t") * 1.5)
    return N.to_windows(k, "m", 20.0, 6.0, 0.0, 20).select("track_id", "t", "t_idx")


@query(f"""{WITH_TRACKS} SELECT a.track_id, a.t, b.t AS n_t FROM tracks AS a JOIN tracks AS b ON a.track_id = b.track_id AND b.t > a.t AND (b.t - a.t) BETWEEN 7.2e0 AND 8.8e0""")
def c13_lag_pairs(spark, sf):
    return N.lag_pairs(tracks(spark, sf).select("track_id", "t"), "track_id", "t", 8.0, 0.1).select("track_id", "t", "n_t")


@query(f"""{WITH_TRACKS}, e AS (SELECT track_id, min(t + 4 * (t // 16)) AS a, t // 16 AS b, max(t + 4 * (t // 16)) AS t_end FROM tracks GROUP BY ALL)
SELECT p.track_id AS parent, q.track_id AS child, CAST(p.t_end AS INT) AS t_end, CAST(q.a AS INT) AS t_start FROM e AS p JOIN e AS q ON q.a BETWEEN p.t_end + 1 AND p.t_end + 6 AND p.track_id = q.track_id""")
def c14_gap_pairs(spark, sf):
    """All rows, with four frames missing after every sixteen."""
    k = tracks(spark, sf).select("track_id", F.expr("t div 16").alias("b"), F.expr("CAST(t + 4 * (t div 16) AS int)").alias("t"))
    e = k.groupBy("track_id", "b").agg(F.min("t").alias("t_start"), F.max("t").alias("t_end"))
    out = N.gap_pairs(e.select(F.col("track_id").alias("parent"), "t_end"), e.select(F.col("track_id").alias("child"), "t_start"), 5)
    return out.where("parent = child").select("parent", "child", "t_end", "t_start")


@query(f"{WITH_TRACKS} SELECT track_id, t FROM tracks WHERE track_id IN (SELECT track_id FROM tracks WHERE mean_fluo > 99) AND track_id NOT IN (SELECT track_id FROM tracks WHERE t > 80)")
def c15_semi_anti(spark, sf):
    k = tracks(spark, sf).select("track_id", "t", "mean_fluo")
    return k.join(k.where("mean_fluo > 99"), "track_id", "left_semi").join(k.where("t > 80"), "track_id", "left_anti").select("track_id", "t")


@query(f"""{WITH_TRACKS} SELECT DISTINCT a.track_id FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND b.track_id = 7 AND a.track_id <> 7
WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)) < 200""")
def c16_near_track(spark, sf):
    return N.near_track(tracks(spark, sf), 7, 200.0)


@query(f"""{WITH_TRACKS}, p AS (SELECT track_id, max(parent_track_id) AS p, min(t) AS f FROM tracks GROUP BY track_id), c AS (SELECT p AS track_id, min(f) AS first_child_t, count(*) AS n FROM p WHERE p >= 0 GROUP BY p)
SELECT p.track_id, c.n IS NOT NULL AS parent_flag, p.p IN (SELECT track_id FROM p) AS child_flag, c.first_child_t, coalesce(c.n, 0) AS n_children FROM p LEFT JOIN c ON p.track_id = c.track_id""")
def c17_family_flags(spark, sf):
    return L.family_flags(tracks(spark, sf))


@query(f"""{WITH_TRACKS} SELECT a.track_id, a.t, b.t AS n_t, {R('b.x - a.x')} AS shift FROM tracks AS a JOIN tracks AS b ON a.track_id = b.track_id AND b.t = a.t + 9""")
def c21_fragment_pairs(spark, sf):
    return rounded(N.fragment_pairs(tracks(spark, sf).select("track_id", "t", "x"), 10).select("track_id", "t", "n_t", (F.col("n_x") - F.col("x")).alias("shift")))


@query(f"{WITH_TRACKS} SELECT CASE WHEN track_id % 4 = 1 THEN track_id + 100000 ELSE track_id END AS track_id, t FROM tracks")
def c22_relabel(spark, sf):
    k = tracks(spark, sf).select("track_id", "t")
    lookup = k.where("track_id % 4 = 1").select(F.col("track_id").alias("old_id"), (F.col("track_id") + 100000).alias("new_id")).distinct()
    return N.relabel(k, lookup)


@query("""WITH s AS (SELECT o_orderkey AS k, o_custkey AS e, o_orderpriority AS c, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders),
p AS (SELECT x.k, y.k AS n_key, x.e = y.e AS is_self, abs(x.a - y.a) / 3.0e0 AS penalty FROM s AS x JOIN s AS y ON x.c = y.c AND x.k <> y.k AND abs(x.a - y.a) <= 3)
SELECT k AS o_orderkey, n_key, is_self, round(0.5e0 / count(*) OVER (PARTITION BY k, is_self), 6) + 0.0e0 AS weight, round(penalty, 6) + 0.0e0 AS penalty FROM p""")
def c23_sequential_pairs(spark, sf):
    o = table(spark, sf, "orders").withColumn("age", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")))
    return rounded(S.sequential_pairs(o, "o_custkey", "o_orderpriority", "age", 3.0, "o_orderkey"))


@query(f"""{WITH_TRACKS} SELECT k.track_id, k.t, false AS is_dropped, k.mean_fluo > 50 AS bright, CAST(track_id % 3 AS INT) AS track_class, {R('x')} AS x, {R('z * 2')} AS z FROM tracks AS k
UNION ALL SELECT 100000 + track_id, t, true, mean_fluo > 50, NULL, {R('x')}, {R('z * 2')} FROM tracks WHERE t = 3""")
def a03_assemble(spark, sf):
    k = tracks(spark, sf)
    base = k.select("track_id", "parent_track_id", "t", "x", "y", "z")
    dropped = k.where("t = 3").select((F.col("track_id") + 100000).alias("track_id"), "t", "x", "y", "z")
    classes = k.select("track_id", "track_class").distinct()
    fluo = k.select("track_id", "t", "mean_fluo").unionByName(k.where("t = 3").select((F.col("track_id") + 100000).alias("track_id"), "t", "mean_fluo"))
    fluo = fluo.withColumn("channel", F.lit(0)).unionByName(fluo.withColumns({"channel": F.lit(1), "mean_fluo": F.lit(0.0)}))
    out = A.assemble_tracks(base, classes, dropped, fluorescence=fluo, voxel_size={"z": 2.0})
    return rounded(out.select("track_id", "t", "is_dropped", (F.col("mean_fluo") > 50).alias("bright"), "track_class", "x", "z"))


@query(f"{WITH_TRACKS} SELECT track_id, t FROM tracks WHERE t NOT IN (SELECT t FROM tracks WHERE t % 2 = 0)")
def a14_resume(spark, sf):
    k = tracks(spark, sf).select("track_id", "t")
    return A.frames_to_do(k, k.where("t % 2 = 0")).select("track_id", "t")


@query(f"""{WITH_TRACKS.replace('WITH ', 'WITH RECURSIVE ')}, p AS (SELECT track_id, max(parent_track_id) AS p, min(t) AS f, max(t) AS l FROM tracks GROUP BY track_id),
r AS (SELECT track_id, track_id AS root FROM p UNION ALL SELECT r.track_id, q.p FROM r JOIN p AS q ON q.track_id = r.root JOIN p AS o ON o.track_id = q.p),
m AS (SELECT r.track_id, r.root FROM r JOIN p ON p.track_id = r.root WHERE p.p NOT IN (SELECT track_id FROM p))
SELECT m.track_id, m.root, q.f AS root_t, p.l AS last_t, p.l - q.f AS span FROM m JOIN p ON p.track_id = m.track_id JOIN p AS q ON q.track_id = m.root""")
def i04_lineage_roots(spark, sf):
    return L.lineage_roots(tracks(spark, sf))
