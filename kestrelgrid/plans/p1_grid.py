"""Problem 1: telemetry onto each flight's regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import millis
from kestrelgrid.operators.regular_grid import regular_grid
from kestrelgrid.sources.tables import table


def usable_fix() -> F.Column:
    """A fix with both coordinates, not both zero."""
    lat, lon = F.col("geo.lat"), F.col("geo.lon")
    return F.col("geo").isNotNull() & lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))


def current_segments(segments: DataFrame) -> DataFrame:
    """Of each (flight_id, segment_no) the statement detected last; ties fall to the longest, then any equal row."""
    return (
        segments.groupBy("flight_id", "segment_no")
        .agg(F.max(F.struct("detected_at", "end_s", "start_s")).alias("s"))
        .select("flight_id", "segment_no", "s.start_s", "s.end_s")
    )


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Altitude above sea level on the grid of every flight: time-weighted mean, coverage and status of each cell."""
    steps = table(spark, sf_dir, "flights").select("flight_id", F.col("grid_step_ms").cast("bigint").alias("step_ms"))
    spans = current_segments(table(spark, sf_dir, "video_segments")).join(steps, "flight_id").select("flight_id", "step_ms", millis(F.col("start_s")).alias("lo_ms"), millis(F.col("end_s")).alias("hi_ms"))
    readings = (
        table(spark, sf_dir, "telemetry")
        .where(usable_fix())
        .select("flight_id", millis(F.col("t")).alias("t_ms"), F.col("geo.alt_msl").alias("value"), F.struct("received_at", "sample_id").alias("rank"))
        .where(F.col("t_ms").isNotNull())
        .join(steps, "flight_id")
    )
    grid = regular_grid(readings, spans, source="flight_id")
    return grid.select("flight_id", "cell_start_ms", "n_samples", "covered_ms", F.round("coverage", 6).alias("coverage"), F.round("mean_value", 6).alias("mean_alt"), "status")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the grid that no usable sample falls in."""
    return p1_grid(spark, sf_dir).where(F.col("n_samples") == 0).select("flight_id", "cell_start_ms")


_SPANS = """
seg AS (
  SELECT flight_id, segment_no, start_s, end_s FROM video_segments
  QUALIFY row_number() OVER (PARTITION BY flight_id, segment_no ORDER BY detected_at DESC NULLS LAST, end_s DESC NULLS LAST, start_s DESC NULLS LAST) = 1
), span AS (
  SELECT s.flight_id, CAST(f.grid_step_ms AS BIGINT) AS step, CAST(round(s.start_s * 1000) AS BIGINT) AS lo, CAST(round(s.end_s * 1000) AS BIGINT) AS hi
  FROM seg s JOIN flights f USING (flight_id) WHERE s.start_s IS NOT NULL AND s.end_s IS NOT NULL AND f.grid_step_ms > 0
), cell AS (
  SELECT DISTINCT flight_id, step, k * step AS cell_start_ms
  FROM (SELECT flight_id, step, unnest(range(CAST(ceil(lo / step) AS BIGINT), CAST(floor(hi / step) AS BIGINT))) AS k FROM span)
), usable AS (
  SELECT t.flight_id, CAST(round(t.t * 1000) AS BIGINT) AS t_ms, t.geo.alt_msl AS v, t.received_at, t.sample_id
  FROM telemetry t
  WHERE isfinite(t.t) AND abs(t.t) < 9e12 AND t.geo IS NOT NULL AND t.geo.lat IS NOT NULL AND t.geo.lon IS NOT NULL AND NOT (t.geo.lat = 0 AND t.geo.lon = 0)
)"""

SQL = {
    "p1_found": f"""WITH {_SPANS}
SELECT c.flight_id, c.cell_start_ms FROM cell c
WHERE NOT EXISTS (SELECT 1 FROM usable u WHERE u.flight_id = c.flight_id AND u.t_ms >= c.cell_start_ms AND u.t_ms < c.cell_start_ms + c.step)""",
    "p1_grid": f"""WITH {_SPANS}, point AS (
  SELECT u.flight_id, f.grid_step_ms AS step, u.t_ms, count(*) AS n, arg_max(coalesce(v, 'nan'::DOUBLE), (received_at, sample_id)) AS v
  FROM usable u JOIN flights f USING (flight_id) GROUP BY ALL
), held AS (
  SELECT *, least(coalesce(lead(t_ms) OVER (PARTITION BY flight_id ORDER BY t_ms), t_ms + 2 * step), t_ms + 2 * step) AS end_ms FROM point
), hit AS (
  SELECT c.flight_id, c.cell_start_ms,
    sum(CASE WHEN h.t_ms >= c.cell_start_ms AND h.t_ms < c.cell_start_ms + c.step THEN h.n ELSE 0 END) AS n,
    sum(CASE WHEN NOT isnan(h.v) THEN greatest(0, least(h.end_ms, c.cell_start_ms + c.step) - greatest(h.t_ms, c.cell_start_ms)) END) AS ms,
    sum(CASE WHEN NOT isnan(h.v) THEN h.v * greatest(0, least(h.end_ms, c.cell_start_ms + c.step) - greatest(h.t_ms, c.cell_start_ms)) END) AS w
  FROM cell c JOIN held h ON h.flight_id = c.flight_id AND h.t_ms < c.cell_start_ms + c.step AND h.end_ms > c.cell_start_ms
  GROUP BY ALL
)
SELECT c.flight_id, c.cell_start_ms, CAST(coalesce(n, 0) AS BIGINT) AS n_samples, CAST(coalesce(ms, 0) AS BIGINT) AS covered_ms, round(coalesce(ms, 0) / c.step, 6) AS coverage,
  CASE WHEN ms > 0 THEN round(w / ms, 6) END AS mean_alt,
  CASE WHEN coalesce(n, 0) > 0 THEN 'observed' WHEN coalesce(ms, 0) > 0 THEN 'held' ELSE 'missing' END AS status
FROM cell c LEFT JOIN hit h USING (flight_id, cell_start_ms)""",
}
QUERIES = {"p1_found": p1_found, "p1_grid": p1_grid}
