"""Materials, series, tables, sets and strings over the driver's tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from orbitrace.operators import clusters as K
from orbitrace.operators import materials as P
from orbitrace.operators import surface as U
from orbitrace.plans.field_queries import _vectors
from orbitrace.plans.geometry_queries import R
from orbitrace.plans.registry import query, rounded
from orbitrace.sources import tables as A
from orbitrace.session import new_scratch
from orbitrace.sources.testviews import WITH_TRACKS, table, tracks


@query(f"""{WITH_TRACKS}, r AS (SELECT a.t, a.track_id, b.track_id AS k, row_number() OVER (PARTITION BY a.t, a.track_id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), b.track_id) AS r
  FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND a.track_id <> b.track_id), m AS (SELECT a.track_id, a.t, CAST(b.t - a.t AS INT) AS lag, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM tracks AS a JOIN tracks AS b
  ON a.track_id = b.track_id AND b.t - a.t IN (1, 2, 4)), c AS (SELECT r.t, r.track_id, m.lag, avg(m.dx) AS cx, avg(m.dy) AS cy, avg(m.dz) AS cz FROM r JOIN m ON m.track_id = r.k AND m.t = r.t WHERE r.r <= 5 GROUP BY ALL HAVING count(*) >= 3)
SELECT m.lag, round(avg(power(m.dx - c.cx, 2) + power(m.dy - c.cy, 2) + power(m.dz - c.cz, 2)), 5) + 0.0e0 AS msd, count(*) AS n FROM m JOIN c ON m.track_id = c.track_id AND m.t = c.t AND m.lag = c.lag GROUP BY m.lag""")
def d29_cage_relative_msd(spark, sf):
    return rounded(P.cage_relative_msd(tracks(spark, sf), 5, 90.0), 5)


@query(f"""{WITH_TRACKS}, r AS (SELECT a.t, a.track_id, b.track_id AS k, b.x - a.x AS ax, b.y - a.y AS ay, b.z - a.z AS az, row_number() OVER (PARTITION BY a.t, a.track_id ORDER BY power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2), b.track_id) AS r
  FROM tracks AS a JOIN tracks AS b ON a.t = b.t AND a.track_id <> b.track_id),
p AS (SELECT r.*, q.x - o.x AS wx, q.y - o.y AS wy, q.z - o.z AS wz FROM r JOIN tracks AS o ON o.track_id = r.track_id AND o.t = r.t + 1 JOIN tracks AS q ON q.track_id = r.k AND q.t = r.t + 1 WHERE r.r <= 8),
s AS (SELECT track_id, t, count(*) AS n, sum(wx*wx + wy*wy + wz*wz) AS bb, sum(ax*ax) AS xx, sum(ax*ay) AS xy, sum(ax*az) AS xz, sum(ay*ay) AS yy, sum(ay*az) AS yz, sum(az*az) AS zz,
  {", ".join(f"sum(a{p}*w{q}) AS m{p}{q}" for p in "xyz" for q in "xyz")} FROM p GROUP BY ALL),
c AS (SELECT *, yy*zz - yz*yz AS cxx, xz*yz - xy*zz AS cxy, xy*yz - xz*yy AS cxz, xx*zz - xz*xz AS cyy, xy*xz - xx*yz AS cyz, xx*yy - xy*xy AS czz FROM s),
d AS (SELECT *, xx*cxx + xy*cxy + xz*cxz AS det FROM c)
SELECT track_id, t, round(CASE WHEN n >= 4 AND abs(det) > 1e-9 * xx * yy * zz THEN greatest(bb - ({" + ".join(f"m{p}{c} * c{''.join(sorted((p, q)))} * m{q}{c}" for p in "xyz" for q in "xyz" for c in "xyz")}) / det, 0) / n END, 3) + 0.0e0 AS d2min FROM d""")
def d29_d2min(spark, sf):
    return rounded(P.d2min(tracks(spark, sf), 8, 100.0), 3)


@query()
def d13_surface_distance(spark, sf):
    return U.surface_distance_filter(tracks(spark, sf), 5.0).select("track_id", "t")


@query(f"""{WITH_TRACKS}, v AS (SELECT track_id, t, x, y, z FROM tracks WHERE track_class = 0), f AS (SELECT t, x, y, z, mean_fluo FROM tracks WHERE track_class = 1)
SELECT v.track_id AS vertex_id, v.t, {R('avg(f.mean_fluo)')} AS mean_fluo_mean, CASE WHEN count(f.t) > 0 THEN count(f.t) END AS n_faces FROM v LEFT JOIN f ON v.t = f.t AND power(v.x - f.x, 2) + power(v.y - f.y, 2) + power(v.z - f.z, 2) <= 22500 GROUP BY ALL""")
def d54_local_face_mean(spark, sf):
    k = tracks(spark, sf)
    v = k.where("track_class = 0").select(F.col("track_id").alias("vertex_id"), "t", "x", "y", "z")
    return rounded(P.local_face_mean(v, k.where("track_class = 1"), 150.0, "mean_fluo").select("vertex_id", "t", "mean_fluo_mean", "n_faces"))


@query(f"""{WITH_TRACKS}, p AS (SELECT t, track_id AS vertex_id, CASE WHEN track_id % 3 = 0 THEN -1 ELSE track_id - track_id % 2 END AS track_id FROM tracks), v AS (SELECT t, track_id, avg(mean_fluo) AS m FROM tracks GROUP BY ALL)
SELECT p.t, p.vertex_id, {R('coalesce(v.m, 0.0e0)')} AS mean_fluo FROM p LEFT JOIN v ON v.t = p.t AND v.track_id = p.track_id""")
def d55_painted_vertices(spark, sf):
    k = tracks(spark, sf)
    patch = F.when(F.col("track_id") % 3 == 0, -1).otherwise(F.col("track_id") - F.col("track_id") % 2).alias("track_id")
    return rounded(P.painted_vertices(k.select("t", F.col("track_id").alias("vertex_id"), patch), k, "mean_fluo").select("t", "vertex_id", "mean_fluo"))


@query(f"{WITH_TRACKS} SELECT {R('avg(CASE WHEN track_id % 4 > 0 AND t > 2 THEN 1.0e0 ELSE 0.0e0 END)')} AS share FROM tracks")
def d57_matched_share(spark, sf):
    k = tracks(spark, sf)
    return rounded(P.frame_share(k, k.where("track_id % 4 > 0 AND t > 2")))


@query()
def d59_predict_class(spark, sf):
    e, names = _vectors(spark, sf)
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    return P.predict_class(e.where(~held), e.where(held), names, "label").select("vec_id", "class_logistic", "class_mlp")


@query()
def d59_predict_age(spark, sf):
    """Age of an order in days, from what its lines add up to."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(*(F.avg(F.col(f"l_{c}").cast("double")).alias(c) for c in ("quantity", "extendedprice", "discount", "tax")), F.count("*").cast("double").alias("n"))
    age = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("age")
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), age).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    held = F.pmod(F.xxhash64("o_orderkey"), F.lit(5)) == 0
    return rounded(P.predict_age(o.where(~held), o.where(held), ["price", "quantity", "extendedprice", "discount", "tax", "n"], "age").select("o_orderkey", "age_linear", "age_trees"), 3)


@query()
def e17_threshold_trend(spark, sf):
    k = tracks(spark, sf).groupBy("track_class", "t").agg(F.avg("mean_fluo").alias("v"))
    return rounded(P.lowess_threshold(k, "track_class", "t", "v"), 4)


@query(f"""{WITH_TRACKS}, h AS (SELECT t, CAST(round_even(y / (100.0e0 * 0.8660254037844386e0), 0) AS BIGINT) AS hy, x FROM tracks), b AS (SELECT t, hy, CAST(round_even(x / 100.0e0 - (hy % 2) * 0.5e0, 0) AS BIGINT) AS hx FROM h),
n AS (SELECT t, hx, hy, count(*) AS n FROM b GROUP BY ALL), f AS (SELECT DISTINCT t FROM tracks), k AS (SELECT a.t, count(*) AS k FROM f AS a JOIN f AS b ON b.t BETWEEN a.t - 25 AND a.t + 25 GROUP BY a.t),
d AS (SELECT f.t, n.hx, n.hy, sum(n.n) / max(k.k) AS density FROM f JOIN n ON n.t BETWEEN f.t - 25 AND f.t + 25 JOIN k ON k.t = f.t GROUP BY ALL),
o AS (SELECT * FROM (VALUES (0, 0, 0), (0, -1, 0), (0, 1, 0), (1, -1, 1), (1, 0, 1), (-1, -1, 1), (-1, 0, 1)) AS v(dy, dx, odd))
SELECT d.t, d.hx, d.hy, {R('max(d.density)')} AS density, {R('sum(e.density) / 7')} AS smooth FROM d CROSS JOIN o JOIN d AS e ON e.t = d.t AND e.hy = d.hy + o.dy AND e.hx = d.hx + o.dx + o.odd * (((d.hy % 2) + 2) % 2) GROUP BY ALL""")
def e25_hex_counts(spark, sf):
    """Counts within 25 frames and their mean over near bins."""
    return rounded(P.hex_counts(tracks(spark, sf), "x", "y", 100.0).select("t", "hx", "hy", "density", "smooth"))


@query("""WITH w AS (SELECT c_custkey, c_nationkey, chr(CAST(65 + c_custkey % 8 AS INT)) AS r FROM customer), p AS (SELECT c_custkey, r, c, c_nationkey + c AS g FROM w, unnest(range(0, 12)) AS u(c))
SELECT c_custkey, r || lpad(CAST(c AS VARCHAR), 2, '0') AS well_id, CAST(g AS VARCHAR) AS genotype FROM p WHERE g % 4 <> 0""")
def a11_plate_map(spark, sf):
    """Every customer is one row, A to H, of a plate of twelve columns; some wells are empty."""
    name = F.chr((65 + F.col("c_custkey") % 8).cast("int"))
    cells = (F.when((F.col("c_nationkey") + c) % 4 != 0, F.col("c_nationkey") + c).alias(str(c + 1)) for c in range(12))
    wide = table(spark, sf, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("#"), name).alias("row"), *cells)
    parts = F.split("well_id", "#")
    return A.plate_map(wide, "genotype").select(parts[0].cast("long").alias("c_custkey"), parts[1].alias("well_id"), "genotype")


@query("SELECT s_suppkey AS series, CAST(c AS INT) AS time_index, CAST((s_suppkey + c) % 3 AS BIGINT) AS qc_flag FROM supplier, unnest([0, 1, 2]) AS u(c)")
def a12_curation(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("series"), *(((F.col("s_suppkey") + c) % 3).alias(str(c)) for c in range(3)))
    return A.curation(s)


@query("""SELECT o_orderkey, c_mktsegment, o_custkey % 7 + epoch(o_orderdate) / 3600.0e0 AS stage, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 3 AS BIGINT) END AS qc_flag FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def a13_frame_metadata(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("series"), F.lit(0).alias("time_index"), F.unix_timestamp("o_orderdate").alias("time"), F.col("o_custkey").alias("well_id"))
    plate = table(spark, sf, "customer").select(F.col("c_custkey").alias("well_id"), "c_mktsegment", (F.col("c_custkey") % 7).alias("start_age_hpf"))
    flags = o.where("series % 4 > 0").select("series", "time_index", (F.col("series") % 3).alias("qc_flag"))
    return A.frame_metadata(o, plate, flags).select(F.col("series").alias("o_orderkey"), "c_mktsegment", "stage", "qc_flag")


@query(f"{WITH_TRACKS} SELECT DISTINCT track_id, track_class FROM tracks WHERE track_class < 2")
def g02_distinct(spark, sf):
    return tracks(spark, sf).where("track_class < 2").select("track_id", "track_class").distinct()


@query(f"{WITH_TRACKS} SELECT track_id FROM tracks EXCEPT SELECT parent_track_id FROM tracks")
def g06_difference(spark, sf):
    k = tracks(spark, sf)
    return k.select("track_id").subtract(k.select(F.col("parent_track_id").alias("track_id")))


@query(f"""{WITH_TRACKS}, a AS (SELECT t, list_sort(list(track_id)) AS a FROM tracks WHERE track_class = 0 GROUP BY t), b AS (SELECT t, list_sort(list(track_id)) AS b FROM tracks WHERE mean_fluo > 40 GROUP BY t),
n AS (SELECT t, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM a JOIN b USING (t)) SELECT t, {R('k / least(na, nb)')} AS overlap, {R('k / (na + nb - k)')} AS jaccard, {R('least(k / na, k / nb)')} AS coverage FROM n""")
def g03_set_scores(spark, sf):
    k = tracks(spark, sf)
    a = k.where("track_class = 0").groupBy("t").agg(F.collect_set("track_id").alias("a"))
    b = k.where("mean_fluo > 40").groupBy("t").agg(F.collect_set("track_id").alias("b"))
    x, y = F.col("a"), F.col("b")
    return rounded(a.join(b, "t").select("t", K.set_overlap(x, y).alias("overlap"), K.jaccard(x, y).alias("jaccard"), K.min_coverage(x, y).alias("coverage")))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number, left(c_name, 4) AS head FROM customer")
def h01_number_in_name(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.regexp_extract("c_name", "([0-9]+)", 1).cast("long").alias("number"), F.substring("c_name", 1, 4).alias("head"))


@query(f"""{WITH_TRACKS}, f AS (SELECT t, track_class, ln(1 + count(*)) AS a, avg(mean_fluo) AS b, avg(x) AS c FROM tracks GROUP BY ALL)
SELECT p.t, p.track_class, {R('(p.a * q.a + p.b * q.b + p.c * q.c) / sqrt((p.a*p.a + p.b*p.b + p.c*p.c) * (q.a*q.a + q.b*q.b + q.c*q.c))')} AS similarity FROM f AS p JOIN f AS q ON q.t = p.t + 1 AND q.track_class = p.track_class""")
def h04_feature_cosine(spark, sf):
    f = tracks(spark, sf).groupBy("t", "track_class").agg(F.array(F.log1p(F.count("*")), F.avg("mean_fluo"), F.avg("x")).alias("f"))
    q = f.select((F.col("t") - 1).alias("t"), "track_class", F.col("f").alias("g"))
    return rounded(f.join(q, ["t", "track_class"]).select("t", "track_class", K.finite_cosine(F.col("f"), F.col("g")).alias("similarity")))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def h06_json_values(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("user_id", "k").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, CAST(count(*) AS INT) AS n, round(min(value), 6) + 0.0e0 AS low, round(max(value), 6) + 0.0e0 AS high FROM events GROUP BY ALL")
def h06_json_maps(spark, sf):
    """A user's values as JSON, a map of arrays by event type, written and read again."""
    per = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.collect_list(F.col("value").cast("double")).alias("v"))
    text = per.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "v")))).alias("j"))
    back = text.select("user_id", F.explode(F.from_json("j", "map<string, array<double>>")).alias("event_type", "v"))
    return rounded(back.select("user_id", "event_type", F.size("v").alias("n"), F.array_min("v").alias("low"), F.array_max("v").alias("high")))


@query(f"{WITH_TRACKS} SELECT track_id, t, CASE track_class WHEN 0 THEN 'deep' WHEN 1 THEN 'EVL' ELSE 'YSN' END AS cell_type FROM tracks")
def h07_recode(spark, sf):
    names = F.create_map(*(F.lit(v) for pair in ((0, "deep"), (1, "EVL"), (2, "YSN")) for v in pair))
    return tracks(spark, sf).select("track_id", "t", names[F.col("track_class")].alias("cell_type"))


@query(f"{WITH_TRACKS} SELECT track_id, parent_track_id, t, {R('x + 1')} AS x, {R('y')} AS y, {R('z')} AS z FROM tracks")
def a01_read_tracks(spark, sf):
    """A run folder with raw and smoothed tracks; the smoothed ones are preferred."""
    folder, k = new_scratch(spark, "run"), tracks(spark, sf).select("track_id", "parent_track_id", "t", "x", "y", "z")
    A.write_table(k, f"{folder}/tracks")
    A.write_table(k.withColumn("x", F.col("x") + 1), f"{folder}/tracks_smoothed")
    return rounded(A.read_tracks(spark, folder, prefer_smoothed=True))


@query(f"{WITH_TRACKS}, r AS (SELECT track_class, min(t) AS a, max(t) AS b FROM tracks GROUP BY track_class), c AS (SELECT track_class FROM r WHERE a <= 5 AND b >= 40 ORDER BY track_class = 1 DESC, b - a, track_class LIMIT 1) "
  "SELECT track_id, t, 'r' || CAST(track_class AS VARCHAR) AS run FROM tracks WHERE track_class = (SELECT track_class FROM c) AND t BETWEEN 5 AND 40")
def a02_read_run(spark, sf):
    """Three runs by class, one with flow; the one with flow covers the frames asked for."""
    root = new_scratch(spark, "runs")
    k = tracks(spark, sf).select("track_id", "t", F.concat(F.lit("r"), "track_class").alias("run"), (F.col("track_class") == 1).alias("with_flow"))
    A.write_runs(k, root)
    return A.read_run(spark, root, 5, 40).select("track_id", "t", "run")


@query("SELECT s_suppkey, s_nationkey * 0.5e0 AS voxel_z, CAST(90 + s_suppkey % 3 AS DOUBLE) AS time_resolution_s, round((90 + s_suppkey % 3) / 60.0e0, 6) + 0.0e0 AS time_resolution_min, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS first_channel, "
  "CAST(CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS INT) AS n_channels FROM supplier")
def a04_attributes(spark, sf):
    """Attribute texts of one dataset per supplier; every second one names no channels."""
    s = table(spark, sf, "supplier")
    made = F.struct(
        F.array(F.col("s_nationkey") * F.lit(0.5), F.lit(0.25), F.lit(0.25)).alias("voxel_size_um"), (90 + F.col("s_suppkey") % 3).alias("time_resolution_s"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array("s_name", F.lit("GFP"))).alias("channels"),
    )
    out = A.dataset_attributes(s.select("s_suppkey", F.to_json(made).alias("attributes")))
    size = F.when(F.col("channels").isNotNull(), F.size("channels"))
    return rounded(out.select("s_suppkey", F.col("voxel_size_um")[0].alias("voxel_z"), "time_resolution_s", "time_resolution_min", F.get("channels", F.lit(0)).alias("first_channel"), size.alias("n_channels")))


@query(f"{WITH_TRACKS} SELECT track_id, t, {R('x')} AS x, CAST(t % 5 AS INT) AS from_file FROM tracks")
def a05_read_frames(spark, sf):
    """Tracks in five folders of CSV files, read back as one table."""
    folder = new_scratch(spark, "csv")
    k = tracks(spark, sf).select("track_id", "t", F.round("x", 6).alias("x"), (F.col("t") % 5).alias("part"))
    k.write.partitionBy("part").option("header", True).csv(folder)
    out = A.read_frames(spark, f"{folder}/*/*.csv", "track_id long, t int, x double")
    return rounded(out.select("track_id", "t", "x", F.regexp_extract("source_file", r"part=([0-9]+)", 1).cast("int").alias("from_file")))


@query(f"{WITH_TRACKS} SELECT track_id, t, {R('x')} AS x FROM tracks")
def f01_sorted_sink(spark, sf):
    """Tracks written in order of track and frame, and read back."""
    path = new_scratch(spark, "sorted")
    A.write_sorted(tracks(spark, sf).select("track_id", "t", "x"), path)
    return rounded(spark.read.parquet(path))
