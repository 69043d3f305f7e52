"""Registered queries that run as streams over the given tables until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from orbitrace.plans.registry import query
from orbitrace.session import materialize, new_scratch
from orbitrace.sources.testviews import table, tracks
from orbitrace.streaming.ingest import segments, sliding_counts
from orbitrace.streaming.linking import link_stream, run_available


def _run(spark, stream):
    folder = new_scratch(spark, "stream")
    run_available(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _events(spark, sf):
    """The events as a stream. A file stream reads a folder, so the table, which may be one file, is written to one."""
    # times without a zone count as UTC, whatever the session's zone
    at = F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz)))")
    rows = table(spark, sf, "events").select("user_id", at.alias("ts"))
    folder = new_scratch(spark, "events")
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query("""WITH w AS (SELECT CAST(floor(epoch(ts) / 900) AS BIGINT) * 900 - 900 * k AS start_s FROM events, range(3) AS r(k))
SELECT start_s, count(*) AS n FROM w WHERE (start_s + 2700) * 1000 <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) GROUP BY start_s""")
def k01_stream_counts(spark, sf):
    """Events in sliding windows, as the watermark closes them: an hour behind the newest event."""
    out = _run(spark, sliding_counts(_events(spark, sf)))
    return out.select(F.unix_seconds("start").alias("start_s"), "n")


@query("""WITH j AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(j) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM j),
g AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, s)
SELECT user_id, start_us, end_us, n FROM g WHERE end_us <= (SELECT max(epoch_us(ts)) // 1000 - 3600000 FROM events) * 1000""")
def k02_stream_segments(spark, sf):
    """A user's events without a gap of over half an hour, as the watermark closes them."""
    out = _run(spark, segments(_events(spark, sf), "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query()
def k03_stream_links(spark, sf):
    """The tracks' points of three classes linked anew as a stream that arrives in four parts; a last row closes each class."""
    folder, parts = new_scratch(spark, "detections"), 4
    k = tracks(spark, sf).select(F.col("track_class").alias("dataset"), F.timestamp_seconds(86400 + F.col("t") * 90).alias("ts"), "t", F.col("track_id").alias("id"), "x", "y", "z")
    k = materialize(k, "points")
    frames = (k.agg(F.max("t")).first()[0] or 0) + 1
    for i in range(parts):
        here = k.where((F.col("t") >= i * frames // parts) & (F.col("t") < (i + 1) * frames // parts))
        here.repartition(2, "dataset").write.mode("append").parquet(folder)
    close = k.groupBy("dataset").agg(F.min("id").alias("id")).select("dataset", F.timestamp_seconds(F.lit(86400 + 3 * frames * 90)).alias("ts"), F.lit(3 * frames).alias("t"), "id", *(F.lit(0.0).alias(a) for a in "xyz"))
    close.write.mode("append").parquet(folder)
    stream = spark.readStream.schema(k.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return _run(spark, link_stream(stream, 15.0, "dataset", late=f"{frames * 90} seconds"))
