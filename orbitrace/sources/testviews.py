"""Track, sphere, voxel, feature and snip tables derived from the star-schema tables.

The SQL is the same in Spark and DuckDB, so it also heads the SQL forms of the registered queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TRACKS = """
SELECT u AS track_id, t,
  CAST(CASE WHEN u > 0 AND u % 5 = 0 THEN CAST(floor(u / 5.0e0) AS BIGINT) ELSE -1 END AS BIGINT) AS parent_track_id,
  CAST(u % 3 AS INT) AS track_class, fluo AS mean_fluo,
  600.0e0 + 0.1e0 * t + r * sin(th) * cos(ph) AS x, 600.0e0 + r * sin(th) * sin(ph) AS y, 300.0e0 + r * cos(th) AS z
FROM (SELECT u, t, fluo,
    0.15e0 + 2.8e0 * ((u * 61) % 997) / 997.0e0 + 0.02e0 * sin(0.3e0 * t) + 0.0002e0 * fluo AS th,
    6.283185307179586e0 * ((u * 137) % 991) / 991.0e0 + 0.01e0 * t + 0.0005e0 * k AS ph,
    500.0e0 + 0.1e0 * (k - 50) AS r
  FROM (SELECT CAST(user_id AS BIGINT) AS u,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
      CAST(value AS DOUBLE) AS fluo, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
    FROM events) AS e) AS g
"""
SPHERE = """
SELECT t, 600.0e0 + 0.1e0 * t AS center_x_smooth, 600.0e0 AS center_y_smooth, 300.0e0 AS center_z_smooth, 500.0e0 AS radius_smooth
FROM (SELECT DISTINCT t FROM tracks) AS d
"""
VOXELS = """
SELECT CAST(month(l_shipdate) AS INT) AS t, CAST(l_suppkey AS BIGINT) AS label, CAST(l_linenumber AS INT) AS channel,
  CAST(l_quantity AS DOUBLE) AS z, CAST(l_partkey % 64 AS BIGINT) AS y, CAST(l_orderkey % 64 AS BIGINT) AS x,
  CAST(l_extendedprice AS DOUBLE) AS intensity
FROM lineitem
"""
#: Heads of SQL forms.
WITH_TRACKS = f"WITH tracks AS ({TRACKS})"
WITH_SPHERE = f"{WITH_TRACKS}, sphere AS ({SPHERE})"
WITH_VOXELS = f"WITH voxels AS ({VOXELS})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRACKS.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SPHERE.replace("FROM tracks", "FROM {tracks}"), tracks=tracks(spark, sf_dir))


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VOXELS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))
