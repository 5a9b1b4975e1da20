"""The telemetry as points: one usable fix for each flight and millisecond, in metres about the flight's first fix.

x, y, z are rounded to millimetres. ``view`` is the span of 20 s a fix falls in, ``tier`` its confidence by accuracy (2
measured, 1 low, 0 inferred), ``label`` 1 while recording, 2 while not, 0 where unknown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import millis
from kestrelgrid.functions.geodesy import enu, enu_sql
from kestrelgrid.sources.derived import derived
from kestrelgrid.sources.tables import table

#: Milliseconds a BIGINT holds with room for sums; buckets of the sequence operators, and views, in ms.
CLOCK_MS, BUCKET_MS, VIEW_MS = 9_000_000_000_000_000, 600_000, 20_000


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with a finite clock, the smallest sample_id of each flight and millisecond; adds t_ms and bucket."""
    return derived(spark, sf_dir, "telemetry", "series", lambda: _series(spark, sf_dir))


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "telemetry").where(F.col("flight_id").isNotNull()).withColumn("t_ms", millis(F.col("t"))).where("t_ms IS NOT NULL")
    fields = ["lat", "lon", "alt_msl", "alt_rel", "accuracy_h", "accuracy_v"]
    plain = ["gimbal_pitch", "gimbal_roll", "gimbal_yaw", "baro_alt", "is_video", "received_at"]
    first = [F.min_by(f"geo.{f}", "sample_id").alias(f"geo_{f}") for f in fields] + [F.min_by(c, "sample_id").alias(c) for c in plain]
    one = rows.groupBy("flight_id", "t_ms").agg(F.min("sample_id").alias("sample_id"), *first)
    geo = F.struct(*[F.col(f"geo_{f}").alias(f) for f in fields]).alias("geo")
    return one.select("flight_id", "t_ms", "sample_id", geo, *plain, F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint").alias("bucket"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, "telemetry", "points", lambda: _points(spark, sf_dir))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon, alt = F.col("geo.lat"), F.col("geo.lon"), F.col("geo.alt_msl")
    fixes = series(spark, sf_dir).where(lat.isNotNull() & lon.isNotNull() & alt.isNotNull() & ~((lat == 0) & (lon == 0)))
    origin = fixes.groupBy("flight_id").agg(F.min(F.struct("t_ms", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))).alias("o"))
    x, y, z = enu(lat, lon, alt, F.col("o.lat"), F.col("o.lon"), F.col("o.alt"))
    acc = F.col("geo.accuracy_h")
    return fixes.join(origin, "flight_id").select(
        "flight_id", "sample_id", "t_ms", "bucket", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"), alt.alias("alt_msl"), F.col("geo.alt_rel").alias("alt_rel"), acc.alias("acc"),
        F.col("gimbal_pitch").alias("pitch"), F.col("gimbal_yaw").alias("yaw"), F.col("gimbal_roll").alias("roll"), F.col("geo.accuracy_v").alias("acc_v"), F.floor(F.col("t_ms") / VIEW_MS).cast("bigint").alias("view"),
        F.when(acc <= 1.0, 2).when(acc <= 2.5, 1).otherwise(0).alias("tier"), F.when(F.col("is_video"), 1).when(~F.col("is_video"), 2).otherwise(0).alias("label"),
    )


_X, _Y, _Z = enu_sql("geo.lat", "geo.lon", "geo.alt_msl", "lat0", "lon0", "alt0")
SERIES = f"""series AS (
  SELECT * EXCLUDE (t), CAST(floor(t * 1000 + 0.5) AS BIGINT) AS t_ms FROM telemetry WHERE flight_id IS NOT NULL AND isfinite(t) AND abs(floor(t * 1000 + 0.5)) < {CLOCK_MS}
  QUALIFY row_number() OVER (PARTITION BY flight_id, floor(t * 1000 + 0.5) ORDER BY sample_id) = 1
)"""
POINTS = f"""{SERIES}, fix AS (
  SELECT *, first_value(geo.lat) OVER w AS lat0, first_value(geo.lon) OVER w AS lon0, first_value(geo.alt_msl) OVER w AS alt0 FROM series
  WHERE geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND geo.alt_msl IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0) WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)
), point AS (
  SELECT flight_id, sample_id, t_ms, round({_X}, 3) + 0.0 AS x, round({_Y}, 3) + 0.0 AS y, round({_Z}, 3) + 0.0 AS z, geo.alt_msl AS alt_msl, geo.alt_rel AS alt_rel, geo.accuracy_h AS acc,
    gimbal_pitch AS pitch, gimbal_yaw AS yaw, gimbal_roll AS roll, geo.accuracy_v AS acc_v, CAST(floor(t_ms / {VIEW_MS}) AS BIGINT) AS view,
    CASE WHEN geo.accuracy_h <= 1.0 THEN 2 WHEN geo.accuracy_h <= 2.5 THEN 1 ELSE 0 END AS tier, CASE WHEN is_video THEN 1 WHEN NOT is_video THEN 2 ELSE 0 END AS label
  FROM fix
)"""
