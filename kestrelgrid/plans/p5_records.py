"""Problem 5: records of exported files into samples and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.operators.record_parsing import CLOCK, NUMBER, judge_samples, number, parse_records
from kestrelgrid.sources.tables import table


def judged_rows(spark: SparkSession, sf_dir: str, *keep: str, more: tuple[str, ...] = ()) -> DataFrame:
    files = table(spark, sf_dir, "raw_files").select("file_no", "delim", "header_line")
    return judge_samples(parse_records(table(spark, sf_dir, "raw_rows").join(files, "file_no", "left"), keep, ("timestamp", "accuracy_h", *more)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bad records and the first reason against each; second deliveries count once."""
    return judged_rows(spark, sf_dir, "row_id").where(F.col("reason").isNotNull()).select("row_id", "reason").distinct()


def p5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid records as samples; other fields are NULL where they hold no number."""
    plain = ("latitude", "longitude", "altitude", "accuracy_v", "satellites")
    numbers = [number(F.col(f"f_{k}")).alias(k) for k in plain]
    return judged_rows(spark, sf_dir, "row_id", "file_no", "line_no", more=(*plain, "remark")).where(F.col("reason").isNull()).select("row_id", "file_no", "line_no", F.round("t", 6).alias("t"), F.col("acc_h").alias("accuracy_h"), *numbers, F.col("f_remark").alias("remark")).distinct()


def p5_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the records declared, delivered, loaded and set apart."""
    rows = judged_rows(spark, sf_dir, "row_id", "file_no").groupBy("file_no", "row_id").agg(F.max("reason").alias("reason"))
    per_file = rows.groupBy("file_no").agg(F.count("*").alias("delivered"), F.count("reason").alias("rejected"))
    files = table(spark, sf_dir, "raw_files").select("file_no", F.col("declared_rows").cast("bigint").alias("declared"))
    joined = files.join(per_file, "file_no", "left").fillna(0, ["delivered", "rejected"])
    return joined.select("file_no", "declared", "delivered", (F.col("delivered") - F.col("rejected")).alias("loaded"), "rejected", (F.col("declared") - F.col("delivered")).alias("short_by"))


def _whole_record(delim: str) -> str:
    """A regular expression of records whose fields are quoted rightly or not at all."""
    own = {"\t": "\\t", "|": "\\|"}.get(delim, delim)
    field = rf'(?:"(?:[^"]|"")*"|[^"{own}][^"{own}]*|)'
    return f"^{field}(?:{own}{field})*$"


#: Delimiters the SQL knows; any other, or an unknown file, is ``no_header`` there.
_DELIMS = (",", ";", "\t", "|")
_SOUND = " ".join(f"WHEN {d!r} THEN regexp_full_match(text, '{_whole_record(d)}')".replace("'\\t'", "chr(9)") for d in _DELIMS)
# quoted numbers lose their quotes, what else is quoted is blanked, and then delimiters part fields
_JUDGED = f"""WITH r AS (
  SELECT DISTINCT row_id, file_no, raw, delim, string_split(header_line, delim) AS names, regexp_replace(coalesce(raw, ''), '\\r$', '') AS text FROM raw_rows LEFT JOIN raw_files USING (file_no)
), c AS (
  SELECT *, CASE delim {_SOUND} END AS sound, string_split(regexp_replace(regexp_replace(text, '"([0-9.:+eE -]*)"', '\\1', 'g'), '"(?:[^"]|"")*"', 'q', 'g'), delim) AS fields FROM r
), f AS (
  SELECT *, fields[list_position(names, 'timestamp')] AS stamp, fields[list_position(names, 'accuracy_h')] AS acc FROM c
), n AS (
  SELECT *, CASE WHEN regexp_matches(stamp, '{CLOCK}') THEN 0.0 WHEN regexp_matches(stamp, '{NUMBER}') THEN TRY_CAST(trim(stamp) AS DOUBLE) END AS t, CASE WHEN regexp_matches(acc, '{NUMBER}') THEN TRY_CAST(trim(acc) AS DOUBLE) END AS a FROM f
), judged AS (
  SELECT row_id, file_no, CASE WHEN sound IS NULL THEN 'no_header' WHEN NOT sound THEN 'quoting' WHEN raw IS NULL OR len(fields) <> len(names) THEN 'column_count'
    WHEN list_contains(names, 'timestamp') AND NOT coalesce(t >= 0 AND isfinite(t), false) THEN 'timestamp'
    WHEN list_contains(names, 'accuracy_h') AND trim(acc) <> '' AND NOT coalesce(a > 0 AND a < 1000, false) THEN 'accuracy_h' END AS reason FROM n
)"""
SQL = {
    "p5_found": f"{_JUDGED} SELECT row_id, reason FROM judged WHERE reason IS NOT NULL",
    "p5_files": f"""{_JUDGED}, g AS (SELECT file_no, count(*) AS delivered, count(reason) AS rejected FROM judged GROUP BY file_no)
SELECT file_no, CAST(declared_rows AS BIGINT) AS declared, coalesce(delivered, 0) AS delivered, coalesce(delivered - rejected, 0) AS loaded, coalesce(rejected, 0) AS rejected, declared_rows - coalesce(delivered, 0) AS short_by FROM raw_files LEFT JOIN g USING (file_no)""",
}
QUERIES = {"p5_found": p5_found, "p5_samples": p5_samples, "p5_files": p5_files}
