"""Problem 2: each frame's telemetry sample nearest in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import millis
from kestrelgrid.llm.nearest_time import match_nearest
from kestrelgrid.sources.tables import table


def flight_lags(estimates: DataFrame) -> DataFrame:
    """(flight_id, lag_ms) of each flight's latest confident estimate with a finite lag; ties fall to the larger sync_id."""
    lag = millis(F.col("lag_s"))
    return (
        estimates.where(F.col("confident") & lag.isNotNull())
        .groupBy("flight_id")
        .agg(F.max(F.struct("estimated_at", "sync_id", lag.alias("lag_ms"))).alias("e"))
        .select("flight_id", "e.lag_ms")
    )


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(flight_id, frame_index, sample_id, apart_ms)."""
    tolerance = table(spark, sf_dir, "flights").select("flight_id", millis(F.col("match_tol_s")).alias("tol_ms"))
    offset = tolerance.join(flight_lags(table(spark, sf_dir, "sync_estimates")), "flight_id", "left")
    frames = table(spark, sf_dir, "frames").select("flight_id", "frame_index", millis(F.col("t")).alias("t_ms")).where(F.col("t_ms").isNotNull()).join(offset, "flight_id")
    samples = table(spark, sf_dir, "telemetry").select("flight_id", "sample_id", millis(F.col("t")).alias("t_ms")).where(F.col("t_ms").isNotNull()).join(tolerance, "flight_id")
    left = frames.select(F.col("flight_id").alias("entity"), F.col("frame_index").alias("left_id"), (F.col("t_ms") + F.coalesce("lag_ms", F.lit(0))).alias("t_ms"), "tol_ms")
    right = samples.select(F.col("flight_id").alias("entity"), F.col("sample_id").alias("right_id"), "t_ms", "tol_ms")
    m = match_nearest(left, right)
    return m.select(F.col("entity").alias("flight_id"), F.col("left_id").alias("frame_index"), F.col("right_id").alias("sample_id"), "apart_ms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).drop("apart_ms")


_MATCHES = """
WITH lag AS (
  SELECT flight_id, CAST(round(lag_s * 1000) AS BIGINT) AS lag_ms FROM sync_estimates WHERE confident AND isfinite(lag_s)
  QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY estimated_at DESC NULLS LAST, sync_id DESC) = 1
), f AS (
  SELECT DISTINCT flight_id, frame_index, CAST(round(t * 1000) AS BIGINT) + coalesce(lag_ms, 0) AS ms, CAST(round(match_tol_s * 1000) AS BIGINT) AS tol
  FROM (SELECT * FROM frames WHERE isfinite(t) AND abs(t) < 9e12) JOIN flights USING (flight_id) LEFT JOIN lag USING (flight_id)
), s AS (
  SELECT flight_id, sample_id, CAST(round(t * 1000) AS BIGINT) AS ms FROM telemetry WHERE isfinite(t) AND abs(t) < 9e12
), hit AS (
  SELECT f.flight_id, frame_index, sample_id, abs(f.ms - s.ms) AS apart_ms
  FROM f JOIN s ON s.flight_id = f.flight_id AND s.ms BETWEEN f.ms - f.tol AND f.ms + f.tol
)
SELECT {columns} FROM hit
QUALIFY row_number() OVER (PARTITION BY flight_id, frame_index ORDER BY apart_ms, sample_id) = 1"""

SQL = {
    "p2_found": _MATCHES.format(columns="flight_id, frame_index, sample_id"),
    "p2_matches": _MATCHES.format(columns="flight_id, frame_index, sample_id, apart_ms"),
}
QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
