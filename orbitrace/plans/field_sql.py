"""DuckDB forms that several field queries share: pixel centres, weighted steps, tangent coordinates, clusters."""

from __future__ import annotations

from orbitrace.plans.geometry_queries import ANGLES, UNITS, R, pix_sql
from orbitrace.sources.testviews import WITH_SPHERE, WITH_VOXELS

STEP_SQL = f"""{WITH_SPHERE}, c AS (SELECT k.track_id, k.t, k.mean_fluo, k.x - s.center_x_smooth AS x, k.y - s.center_y_smooth AS y, k.z - s.center_z_smooth AS z FROM tracks AS k JOIN sphere AS s ON k.t = s.t),
st AS (SELECT *, (x - lag(x) OVER w) / 1.5e0 AS vx, (y - lag(y) OVER w) / 1.5e0 AS vy, (z - lag(z) OVER w) / 1.5e0 AS vz, (x + lag(x) OVER w) / 2 AS mx, (y + lag(y) OVER w) / 2 AS my, (z + lag(z) OVER w) / 2 AS mz,
  (mean_fluo + lag(mean_fluo) OVER w) / 2 AS mid_fluo FROM c WINDOW w AS (PARTITION BY track_id ORDER BY t)),
a AS (SELECT *, sqrt(mx*mx + my*my + mz*mz) AS radius, acos(least(greatest(mz / sqrt(mx*mx + my*my + mz*mz), -1.0e0), 1.0e0)) AS theta,
  CASE WHEN atan2(my, mx) < 0 THEN atan2(my, mx) + 2 * pi() ELSE atan2(my, mx) END AS phi FROM st WHERE vx IS NOT NULL)"""


def clipped_acos(e: str) -> str:
    return f"acos(least(greatest({e}, -1.0e0), 1.0e0))"


def pixels_sql(n: int) -> str:
    """Table ``px`` of the pixel centres of a resolution."""
    total, cap = 12 * n * n, 2 * n * (n - 1)
    return f"""pr AS (SELECT CAST(p AS BIGINT) AS pix, CAST(CASE WHEN p < {cap} THEN floor((1 + sqrt(1 + 2.0e0 * p)) / 2) WHEN p >= {total - cap} THEN floor((1 + sqrt(1 + 2.0e0 * ({total - 1} - p))) / 2)
  ELSE {n} + (p - {cap}) // {4 * n} END AS BIGINT) AS i FROM range({total}) AS r(p)),
pc AS (SELECT pix, {clipped_acos(f'CASE WHEN pix < {cap} THEN 1 - i * i / {3.0 * n * n}e0 WHEN pix >= {total - cap} THEN i * i / {3.0 * n * n}e0 - 1 ELSE 4.0e0 / 3 - 2 * i / {3.0 * n}e0 END')} AS pth,
  pi() / 2 * CASE WHEN pix < {cap} THEN (pix - 2 * i * (i - 1) + 0.5e0) / i WHEN pix >= {total - cap} THEN (4 * i - ({total - 1} - pix - 2 * i * (i - 1)) - 0.5e0) / i
  ELSE ((pix - {cap}) % {4 * n} + CASE WHEN (i + {n}) % 2 = 0 THEN 0.5e0 ELSE 0.0e0 END) / {n}.0e0 END AS pph FROM pr),
px AS (SELECT pix, sin(pth) * cos(pph) AS nx, sin(pth) * sin(pph) AS ny, cos(pth) AS nz FROM pc)"""


def windows_sql(window: float, stride: float) -> str:
    """Table ``wd``: the steps of ``pix`` in every window that holds their middle time."""
    return f"""mt AS (SELECT *, (t - 0.5e0) * 1.5e0 AS mid_time FROM pix), w0 AS (SELECT min(mid_time) AS lo, CAST(ceil((max(mid_time) + {stride}e0 - min(mid_time)) / {stride}e0 - 1e-9) AS INT) AS k FROM mt),
wd AS (SELECT mt.*, CAST(u.i AS INT) AS t_idx FROM mt, w0, unnest(range(0, w0.k)) AS u(i) WHERE abs(mt.mid_time - (w0.lo + u.i * {stride}e0)) <= {window / 2}e0)"""


def spread_sql(n: int, sigma: float, window: float, stride: float, least: float) -> str:
    """Table ``sw``: steps at the pixels within two sigmas, with their Gaussian weight ``w`` over ``least``."""
    angle = clipped_acos("(w.mx * q.nx + w.my * q.ny + w.mz * q.nz) / w.radius")
    return f"""{STEP_SQL}, {pix_sql(n)}, {pixels_sql(n)}, {windows_sql(window, stride)},
sp AS (SELECT w.track_id, w.t, w.t_idx, w.pix AS home, q.pix, q.nx, q.ny, q.nz, w.mx, w.my, w.mz, w.vx, w.vy, w.vz, w.mid_fluo, w.mid_time, {angle} AS ang FROM wd AS w, px AS q WHERE {angle} <= {2 * sigma}e0),
sw AS (SELECT *, exp(-0.5e0 * power(ang / {sigma}e0, 2)) AS w FROM sp WHERE exp(-0.5e0 * power(ang / {sigma}e0, 2)) > {least}e0)"""


def tangent_sql(source: str, radius: float) -> str:
    """Table ``tc``: ``source`` with place ``u, v`` and velocity ``vu, vv`` in the tangent plane of its pixel."""
    return f"""t0 AS (SELECT *, CASE WHEN abs(nz) > 0.95e0 THEN ny ELSE nz END AS rd, CASE WHEN abs(nz) > 0.95e0 THEN 1.0e0 ELSE 0.0e0 END AS ry FROM {source}),
t1 AS (SELECT *, -rd * nx AS ex, ry - rd * ny AS ey, 1 - ry - rd * nz AS ez FROM t0), t2 AS (SELECT *, sqrt(ex*ex + ey*ey + ez*ez) AS es FROM t1),
t3 AS (SELECT *, (ey * nz - ez * ny) / es AS fx, (ez * nx - ex * nz) / es AS fy, (ex * ny - ey * nx) / es AS fz, mx - {radius}e0 * nx AS qx, my - {radius}e0 * ny AS qy, mz - {radius}e0 * nz AS qz FROM t2),
tc AS (SELECT *, (qx * ex + qy * ey + qz * ez) / es AS u, qx * fx + qy * fy + qz * fz AS v, (vx * ex + vy * ey + vz * ez) / es AS vu, vx * fx + vy * fy + vz * fz AS vv FROM t3)"""


#: Tables ``fs`` (sums) and ``vf`` (the affine fit) of ``tc`` per window and pixel.
FIT_SQL = """fs AS (SELECT t_idx, pix, count(*) AS n_steps, sum(w) AS s, sum(w * u) AS su, sum(w * v) AS sv, sum(w * u * u) AS suu, sum(w * u * v) AS suv, sum(w * v * v) AS svv,
  sum(w * vu) AS a0, sum(w * vu * u) AS a1, sum(w * vu * v) AS a2, sum(w * vv) AS b0, sum(w * vv * u) AS b1, sum(w * vv * v) AS b2 FROM tc GROUP BY t_idx, pix HAVING count(*) >= 6 AND bool_or(home = pix)),
fd AS (SELECT *, suu * svv - suv * suv AS c00, sv * suv - su * svv AS c01, su * suv - sv * suu AS c02, s * svv - sv * sv AS c11, su * sv - s * suv AS c12, s * suu - su * su AS c22 FROM fs),
fe AS (SELECT *, CASE WHEN abs(s * c00 + su * c01 + sv * c02) > 1e-9 * s * suu * svv THEN s * c00 + su * c01 + sv * c02 END AS det FROM fd),
vf AS (SELECT t_idx, pix, n_steps, (c00 * a0 + c01 * a1 + c02 * a2) / det AS drift_u, (c01 * a0 + c11 * a1 + c12 * a2) / det AS j00, (c02 * a0 + c12 * a1 + c22 * a2) / det AS j01,
  (c00 * b0 + c01 * b1 + c02 * b2) / det AS drift_v, (c01 * b0 + c11 * b1 + c12 * b2) / det AS j10, (c02 * b0 + c12 * b1 + c22 * b2) / det AS j11 FROM fe)"""

RECURSIVE = f"{WITH_SPHERE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {UNITS}"
#: Tables ``e`` (near pairs within 0.3 rad) and ``k`` (component and size per cell).
COMPONENTS = f"""{RECURSIVE}, e AS (SELECT a.t, a.track_id AS x, b.track_id AS y, sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) AS d FROM u AS a JOIN u AS b ON a.t = b.t AND a.track_id <> b.track_id
  WHERE sqrt(power(a.ux - b.ux, 2) + power(a.uy - b.uy, 2) + power(a.uz - b.uz, 2)) <= 2 * sin(0.15e0)),
r AS (SELECT DISTINCT t, x, x AS y FROM e UNION SELECT r.t, r.x, e.y FROM r JOIN e ON e.t = r.t AND e.x = r.y),
k AS (SELECT t, x AS track_id, min(y) AS component, count(*) AS size FROM r GROUP BY t, x)"""
#: Table ``cs``: one row of statistics per cluster of four cells or more.
CLUSTERS = f"""{COMPONENTS}, dg AS (SELECT t, x, count(*) AS degree, avg(2 * asin(least(d / 2, 1.0e0)) * 500) AS nd FROM e GROUP BY t, x),
cm AS (SELECT u.t, k.component AS cluster_id, u.track_id, u.ux, u.uy, u.uz, u.mean_fluo, dg.degree, dg.nd FROM k JOIN u ON u.t = k.t AND u.track_id = k.track_id JOIN dg ON dg.t = k.t AND dg.x = k.track_id WHERE k.size >= 4),
c0 AS (SELECT t, cluster_id, count(*) AS size, CAST(sum(CAST(mean_fluo AS DECIMAL(28, 10))) AS DOUBLE) / count(*) AS fluo_mean, avg(degree) AS deg_mean, avg(nd) AS nn_dist_mean,
  sum(ux) AS sx, sum(uy) AS sy, sum(uz) AS sz FROM cm GROUP BY ALL),
cs AS (SELECT *, sx / sqrt(sx*sx + sy*sy + sz*sz) AS cx, sy / sqrt(sx*sx + sy*sy + sz*sz) AS cy, sz / sqrt(sx*sx + sy*sy + sz*sz) AS cz FROM c0)"""

#: Table ``ev``: eigenvalues ``e1 >= e2 >= e3`` of each region's coordinate covariance.
EIGEN = f"""{WITH_VOXELS}, g0 AS (SELECT t, label, count(*) AS n, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(x, z) AS e, covar_pop(y, z) AS f FROM voxels WHERE label > 0 GROUP BY ALL),
g1 AS (SELECT *, (a + b + c) / 3 AS q FROM g0), g2 AS (SELECT *, sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6) AS p FROM g1),
g3 AS (SELECT *, CASE WHEN p > 1e-12 THEN acos(least(greatest(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p * p * p), -1.0e0), 1.0e0)) / 3 ELSE 0 END AS h FROM g2),
ev AS (SELECT t, label, n, q + 2 * p * cos(h) AS e1, q + 2 * p * cos(h - 2 * pi() / 3) AS e2, q + 2 * p * cos(h + 2 * pi() / 3) AS e3 FROM g3)"""

D22 = f"""{spread_sql(4, 0.2, 45.0, 15.0, 0.01)}, kt AS (SELECT t_idx, count(DISTINCT mid_time) AS k FROM wd GROUP BY t_idx), ds AS (SELECT t_idx, pix, sum(w) AS s, sum(w * mid_fluo) AS f FROM sw GROUP BY ALL)
SELECT kt.t_idx, px.pix, {R('coalesce(ds.s, 0.0e0) / (4 * pi() / 192) / kt.k')} AS density, {R('ds.f / ds.s')} AS fluo FROM kt CROSS JOIN px LEFT JOIN ds ON ds.t_idx = kt.t_idx AND ds.pix = px.pix"""
_TC = f"{spread_sql(4, 0.3, 45.0, 15.0, 0.01)}, {tangent_sql('sw', 500.0)}"
_FIT = f"{spread_sql(4, 0.3, 45.0, 15.0, 0.001)}, {tangent_sql('sw', 500.0)}, {FIT_SQL}"
D23 = f"""{_FIT} SELECT t_idx, pix, n_steps, {', '.join(f'round({c}, 4) + 0.0e0 AS {c}' for c in ('drift_u', 'j00', 'j01', 'drift_v', 'j10', 'j11'))},
  round(j00 + j11, 4) + 0.0e0 AS divergence, round(j10 - j01, 4) + 0.0e0 AS curl, round(sqrt(drift_u * drift_u + drift_v * drift_v), 4) + 0.0e0 AS drift_speed FROM vf"""
D24 = f"{_TC} SELECT t_idx, pix, {R('sum(w * sqrt(vu * vu + vv * vv)) / sum(w)')} AS path_speed, count(*) AS n_steps FROM tc GROUP BY t_idx, pix HAVING count(*) >= 6"
def _pairs(n: int, sigma: float) -> str:
    """Table ``un``: directions of the weighted steps of every window and pixel, numbered."""
    return f"""{spread_sql(n, sigma, 45.0, 15.0, 0.01)}, un AS (SELECT t_idx, pix, w, vx / sqrt(vx*vx + vy*vy + vz*vz) AS a, vy / sqrt(vx*vx + vy*vy + vz*vz) AS b, vz / sqrt(vx*vx + vy*vy + vz*vz) AS c,
  row_number() OVER (PARTITION BY t_idx, pix ORDER BY track_id, t) AS i FROM sw WHERE sqrt(vx*vx + vy*vy + vz*vz) > 1e-6)"""


D25 = f"""{_pairs(4, 0.3)} SELECT p.t_idx, p.pix, {R('sum(p.w * q.w * (p.a * q.a + p.b * q.b + p.c * q.c)) / sum(p.w * q.w)')} AS alignment
FROM un AS p JOIN un AS q ON p.t_idx = q.t_idx AND p.pix = q.pix AND p.i < q.i GROUP BY ALL"""
D26 = f"""{_pairs(4, 0.15)}, h AS (SELECT p.t_idx, p.pix, least(floor({clipped_acos('p.a * q.a + p.b * q.b + p.c * q.c')} * 36 / pi()), 35) AS bin, sum(p.w * q.w) AS s
  FROM un AS p JOIN un AS q ON p.t_idx = q.t_idx AND p.pix = q.pix AND p.i < q.i GROUP BY ALL), s AS (SELECT *, s / sum(s) OVER (PARTITION BY t_idx, pix) AS p FROM h)
SELECT t_idx, pix, {R('-sum(p * ln(p)) / ln(36)')} AS entropy FROM s GROUP BY ALL"""
D36 = f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(2)}, i AS (SELECT *, t * 1.5e0 AS tm, row_number() OVER (PARTITION BY track_id ORDER BY t) AS i FROM pix),
w0 AS (SELECT min(tm) AS lo, CAST(ceil((max(tm) + 15 - min(tm)) / 15 - 1e-9) AS INT) AS k FROM i),
p AS (SELECT a.pix, b.i - a.i AS lag, a.tm AS t0, b.tm AS t1, power(b.x - a.x, 2) + power(b.y - a.y, 2) + power(b.z - a.z, 2) AS d2 FROM i AS a JOIN i AS b ON a.track_id = b.track_id AND a.pix = b.pix AND b.i - a.i IN (1, 2, 4)
  WHERE (SELECT count(*) FROM i AS c WHERE c.track_id = a.track_id AND c.i BETWEEN a.i AND b.i AND c.pix <> a.pix) = 0),
m AS (SELECT CAST(u.g AS INT) AS t_idx, p.pix, p.lag, avg(p.d2) AS msd, avg(p.t1 - p.t0) AS tau FROM p, w0, unnest(range(0, w0.k)) AS u(g) WHERE abs(p.t0 - w0.lo - u.g * 15) <= 22.5e0 AND abs(p.t1 - w0.lo - u.g * 15) <= 22.5e0 GROUP BY ALL)
SELECT t_idx, pix, {R('arg_max(msd, lag)')} AS msd_value, {R('CASE WHEN count(*) > 1 THEN regr_slope(ln(msd), ln(tau)) END')} AS msd_alpha FROM m WHERE msd > 0 GROUP BY ALL"""
D28 = f"""{spread_sql(2, 0.5, 10000.0, 10000.0, 0.001)}, {tangent_sql('sw', 500.0)}, {FIT_SQL}, hm AS (SELECT p.*, q.nx, q.ny, q.nz FROM pix AS p JOIN px AS q ON p.pix = q.pix),
{tangent_sql('hm', 500.0).replace('t0 AS', 'h0t AS').replace('t1 AS', 'h1t AS').replace('t2 AS', 'h2t AS').replace('t3 AS', 'h3t AS').replace('FROM t0', 'FROM h0t').replace('FROM t1', 'FROM h1t').replace('FROM t2', 'FROM h2t').replace('FROM t3', 'FROM h3t').replace('tc AS', 'hc AS')},
rs AS (SELECT h.pix, h.track_id, h.t, 1.5e0 * (h.vu - f.drift_u - f.j00 * h.u - f.j01 * h.v) AS a, 1.5e0 * (h.vv - f.drift_v - f.j10 * h.u - f.j11 * h.v) AS b FROM hc AS h JOIN vf AS f ON f.pix = h.pix AND f.t_idx = 0),
rc AS (SELECT *, a - avg(a) OVER p AS ca, b - avg(b) OVER p AS cb FROM rs WINDOW p AS (PARTITION BY pix)), rl AS (SELECT *, ca * lag(ca) OVER w AS la, cb * lag(cb) OVER w AS lb FROM rc WINDOW w AS (PARTITION BY pix, track_id ORDER BY t)),
rv AS (SELECT pix, count(*) AS n, (avg(ca * ca) + avg(cb * cb)) / 2 AS v, (avg(la) + avg(lb)) / 2 AS k FROM rl GROUP BY pix)
SELECT pix, n, round((v + 2 * k) / 3, 4) + 0.0e0 AS diffusion, round(greatest(-k, 0.0e0), 4) + 0.0e0 AS noise FROM rv"""
D38 = f"""{_FIT} SELECT t_idx, pix, round((j00 + j11) * (4 * pi() * 250000 / 192), 3) + 0.0e0 AS net_flux, round(sqrt(drift_u * drift_u + drift_v * drift_v) * sqrt(4 * pi() * 250000 / 192), 3) + 0.0e0 AS throughput FROM vf"""
C11 = f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, {pixels_sql(4)}, nb AS (SELECT p.pix, count(*) AS n_near FROM px AS p, px AS q WHERE {clipped_acos('p.nx * q.nx + p.ny * q.ny + p.nz * q.nz')} <= {3.141592653589793 / 9!r}e0 GROUP BY p.pix)
SELECT pix.track_id, pix.t, nb.n_near FROM pix JOIN nb ON nb.pix = pix.pix"""
I08 = f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, {pixels_sql(4)}, ag AS (SELECT p.pix, q.pix AS src, {clipped_acos('p.nx * q.nx + p.ny * q.ny + p.nz * q.nz')} AS ang FROM px AS p, px AS q),
rk AS (SELECT *, row_number() OVER (PARTITION BY pix ORDER BY round(ang, 6), src) AS r FROM ag WHERE ang <= 0.6e0), m AS (SELECT t, pix, avg(mean_fluo) AS v FROM pix GROUP BY ALL)
SELECT m.t, rk.pix, {R('sum(exp(-0.5e0 * power(rk.ang / 0.2e0, 2)) * m.v) / sum(exp(-0.5e0 * power(rk.ang / 0.2e0, 2)))')} AS value_smooth FROM rk JOIN m ON m.pix = rk.src WHERE rk.r <= 25 GROUP BY ALL"""
I10 = f"""{WITH_SPHERE}, {ANGLES}, g AS (SELECT t, CAST(round_even(theta / pi() * 18, 0) AS INT) AS i, CAST(round_even(phi / (2 * pi()) * 36, 0) AS INT) % 36 AS j, mean_fluo AS v FROM a),
h AS (SELECT t, i, CASE WHEN i IN (0, 18) THEN 0 ELSE j END AS j, count(*) AS n, avg(v) AS m FROM g GROUP BY ALL),
o AS (SELECT h.t, h.i + a.o AS i, h.j + b.o AS j, exp(-0.5e0 * (a.o * a.o + b.o * b.o)) * h.n * greatest(sin(h.i * pi() / 18), 1e-3) AS w, h.m FROM h, unnest(range(-3, 4)) AS a(o), unnest(range(-3, 4)) AS b(o)),
f AS (SELECT t, CAST(CASE WHEN i < 0 THEN -i WHEN i > 18 THEN 36 - i ELSE i END AS INT) AS i, CAST((j + CASE WHEN i < 0 OR i > 18 THEN 18 ELSE 0 END + 72) % 36 AS INT) AS j, w, m FROM o)
SELECT t, i, j, {R('sum(w * m) / sum(w)')} AS smooth FROM f GROUP BY ALL"""
D31 = f"""{WITH_SPHERE}, c AS (SELECT t, x - avg(x) OVER p AS x, y - avg(y) OVER p AS y, z - avg(z) OVER p AS z, avg(x) OVER p AS mx, avg(y) OVER p AS my, avg(z) OVER p AS mz FROM tracks WINDOW p AS (PARTITION BY t)),
s AS (SELECT t, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, count(*) AS n, 2 * avg(x*x) AS a, 2 * avg(y*y) AS b, 2 * avg(z*z) AS c, 2 * avg(x*y) AS d, 2 * avg(x*z) AS e, 2 * avg(y*z) AS f,
  avg(x * (x*x + y*y + z*z)) AS p, avg(y * (x*x + y*y + z*z)) AS q, avg(z * (x*x + y*y + z*z)) AS r, avg(x*x + y*y + z*z) AS w FROM c GROUP BY t),
v AS (SELECT *, CASE WHEN n > 3 AND abs(a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) > 1e-9 * a * b * c THEN a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e) END AS det FROM s),
k AS (SELECT *, (p * (b * c - f * f) + q * (e * f - d * c) + r * (d * f - b * e)) / det AS dx, (p * (e * f - d * c) + q * (a * c - e * e) + r * (d * e - a * f)) / det AS dy,
  (p * (d * f - b * e) + q * (d * e - a * f) + r * (a * b - d * d)) / det AS dz FROM v)
SELECT t, round(mx + dx, 3) + 0.0e0 AS center_x, round(my + dy, 3) + 0.0e0 AS center_y, round(mz + dz, 3) + 0.0e0 AS center_z, round(sqrt(w + dx*dx + dy*dy + dz*dz), 3) + 0.0e0 AS radius FROM k"""
D12 = f"""{EIGEN}, x AS (SELECT t, label, sqrt(5 * greatest(e1, 0)) AS axis_a, sqrt(5 * greatest(e2, 0)) AS axis_b, sqrt(5 * greatest(e3, 0)) AS axis_c FROM ev)
SELECT t, label, {R('axis_a')} AS axis_a, {R('axis_b')} AS axis_b, {R('axis_c')} AS axis_c, {R('axis_a / (axis_b + 1e-4)')} AS eccentricity FROM x WHERE axis_a / (axis_b + 1e-4) <= 2 AND axis_b >= 2"""
C20 = f"""{CLUSTERS}, pr AS (SELECT q.t, p.cluster_id AS prev_id, q.cluster_id AS curr_id, {clipped_acos('p.cx * q.cx + p.cy * q.cy + p.cz * q.cz')} AS angle,
  (ln(1 + p.size) * ln(1 + q.size) + p.fluo_mean * q.fluo_mean + p.deg_mean * q.deg_mean + p.nn_dist_mean * q.nn_dist_mean)
  / sqrt((power(ln(1 + p.size), 2) + power(p.fluo_mean, 2) + power(p.deg_mean, 2) + power(p.nn_dist_mean, 2)) * (power(ln(1 + q.size), 2) + power(q.fluo_mean, 2) + power(q.deg_mean, 2) + power(q.nn_dist_mean, 2))) AS similarity
  FROM cs AS p JOIN cs AS q ON q.t = p.t + 1)
SELECT t, prev_id, curr_id, {R('angle')} AS angle, {R('similarity')} AS similarity FROM pr WHERE angle <= 0.2e0 AND similarity >= 0.5e0"""
G04 = f"""{CLUSTERS}, pr AS (SELECT p.t AS ta, p.cluster_id AS a, q.t AS tb, q.cluster_id AS b FROM cs AS p JOIN cs AS q ON q.t = p.t + 1),
nr AS (SELECT pr.*, m.track_id AS x, n.track_id AS y FROM pr JOIN cm AS m ON m.t = pr.ta AND m.cluster_id = pr.a JOIN cm AS n ON n.t = pr.tb AND n.cluster_id = pr.b
  WHERE sqrt(power(m.ux - n.ux, 2) + power(m.uy - n.uy, 2) + power(m.uz - n.uz, 2)) <= 2 * sin(0.05e0)),
hs AS (SELECT ta, a, tb, b, count(DISTINCT x) AS ha, count(DISTINCT y) AS hb FROM nr GROUP BY ALL)
SELECT h.tb AS t, h.a AS prev_id, h.b AS curr_id, {R('least(h.ha / p.size, h.hb / q.size)')} AS sim FROM hs AS h JOIN cs AS p ON p.t = h.ta AND p.cluster_id = h.a JOIN cs AS q ON q.t = h.tb AND q.cluster_id = h.b"""
A07 = f"""{spread_sql(4, 0.2, 45.0, 15.0, 0.01)}, kt AS (SELECT t_idx, count(DISTINCT mid_time) AS k FROM wd GROUP BY t_idx), ds AS (SELECT t_idx, pix, sum(w) AS s, sum(w * mid_fluo) AS f FROM sw GROUP BY ALL),
fl AS (SELECT ds.t_idx, ds.pix, ds.s / (4 * pi() / 192) / kt.k AS density, ds.f / ds.s AS fluo FROM ds JOIN kt ON kt.t_idx = ds.t_idx),
ra AS (SELECT track_id, t, sqrt(x*x + y*y + z*z) AS rr, x, y, z FROM c), {pix_sql(4).replace('h0 AS', 'j0 AS').replace('h1 AS', 'j1 AS').replace('h2 AS', 'j2 AS').replace('h3 AS', 'j3 AS').replace('FROM h0', 'FROM j0').replace('FROM h1', 'FROM j1').replace('FROM h2', 'FROM j2').replace('FROM h3', 'FROM j3').replace('pix AS (SELECT', 'rp AS (SELECT').replace('FROM a)', f"FROM (SELECT *, {clipped_acos('z / rr')} AS theta, CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END AS phi FROM ra) AS q)")}
SELECT r.track_id, r.t, {R('fl.density')} AS density, {R('fl.fluo')} AS fluo FROM rp AS r LEFT JOIN fl ON fl.pix = r.pix
  AND fl.t_idx = least(greatest(ceil((r.t * 1.5e0 - 0.75e0) / 15 - 0.5e0), 0), (SELECT max(t_idx) FROM fl))"""


def _jacobi(rounds: int, tau: float) -> str:
    steps = ["q0 AS (SELECT t, pix, b AS f FROM b0)"]
    for k in range(rounds):
        steps.append(
            f"q{k + 1} AS (SELECT b.t, b.pix, (b.b + {tau}e0 * coalesce(sum(q.f), 0)) / (1 + {tau}e0 * count(q.f)) AS f FROM b0 AS b LEFT JOIN nb ON nb.pix = b.pix "
            f"LEFT JOIN q{k} AS q ON q.t = b.t AND q.pix = nb.src GROUP BY b.t, b.pix, b.b)"
        )
    return ", ".join(steps)


I09 = f"""{WITH_SPHERE}, {ANGLES}, {pix_sql(4)}, {pixels_sql(4)}, b0 AS (SELECT t, pix, avg(mean_fluo) AS b FROM pix GROUP BY ALL),
nb AS (SELECT p.pix, q.pix AS src FROM px AS p JOIN px AS q ON p.pix <> q.pix WHERE {clipped_acos('p.nx * q.nx + p.ny * q.ny + p.nz * q.nz')} <= 1.5e0 * sqrt(4 * pi() / 192)), {_jacobi(5, 0.5)}
SELECT t, pix, {R('f')} AS value_smooth FROM q5"""
I07 = f"""{WITH_SPHERE.replace('WITH ', 'WITH RECURSIVE ', 1)}, k AS (SELECT track_id, t, x, y, z FROM tracks UNION ALL SELECT track_id + 1000000, t, x + 1.0e0, y, z FROM tracks WHERE track_id % 5 = 0),
m AS (SELECT a.track_id AS a, b.track_id AS b FROM k AS a JOIN k AS b ON a.t = b.t AND a.track_id < b.track_id GROUP BY ALL
  HAVING count(*) >= 5 AND quantile_cont(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 0.5) < 3),
e AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT coalesce(c.c, k.track_id) AS track_id, k.t, {R('avg(k.x)')} AS x, count(*) AS n_fused FROM k LEFT JOIN c ON c.a = k.track_id GROUP BY coalesce(c.c, k.track_id), k.t"""
