"""Problem 4: all stated accuracies in millimetres."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.lengths import CUES, IN_BRACKETS, NUMBER_AND_UNIT, UNITS
from kestrelgrid.operators.stated_units import notation_units, read_cells, to_millimetres
from kestrelgrid.sources.derived import written
from kestrelgrid.sources.tables import table


def accuracy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each accuracy cell: (id, axis, source, header, cell, unit_text, note)."""
    both = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(f"field_{a}").alias("header"), F.col(f"accuracy_{a}").alias("cell")) for a in "hv"])
    rows = table(spark, sf_dir, "accuracy_readings")
    return rows.select(F.col("reading_id").alias("id"), F.col("receiver_id").alias("source"), "unit_text", "note", F.explode(both).alias("c")).select("id", "c.axis", "source", "c.header", "c.cell", "unit_text", "note")


def _receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "receivers").select(F.col("receiver_id").alias("source"), "description")


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_millimetres(accuracy_cells(spark, sf_dir), _receivers(spark, sf_dir)).select(F.col("id").alias("reading_id"), "axis", F.col("mm").alias("accuracy_mm"), "stated_in")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_values(spark, sf_dir).drop("stated_in")


def p4_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notation with what it names, what its links to other notations say, and the unit that holds."""
    found = notation_units(written(read_cells(accuracy_cells(spark, sf_dir), _receivers(spark, sf_dir))))
    return found.select(F.col("source").alias("notation"), "readings", "anchor_mm", F.round("linked_mm", 4).alias("linked_mm"), F.round("error", 4).alias("error"), "snapped_mm", "mm", "hops")


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# the SQL reads every phrase of the texts by a table, and estimates nothing
_PHRASES = {
    "1000000": ["thousands of metres"], "1000": ["si base units of length", "whole metres with decimals"], "100": ["tenths of a metre", "1/10 m"], "10": ["hundredths of a metre", "1/100 m"],
    "1": ["thousandths of a metre", "1/1000 m"], "0.001": ["millionths of a metre"], "914.4": ["lengths of three feet"], "304.8": ["international feet"], "25.4": ["twelfths of a foot"],
}
MM_BY_UNIT = {form: mm for table in (UNITS, _PHRASES) for mm, forms in table.items() for form in forms}
_IN_TEXT = "|".join(sorted((form for form in MM_BY_UNIT if len(form) > 1 and form != "in"), key=lambda form: (-len(form), form)))
IN_PROSE = rf"(?:{CUES})[^;.]*?\b({_IN_TEXT})\b"


def _sql(columns: str) -> str:
    units = ", ".join(f"({_literal(form)}, {mm}::DECIMAL(11,3))" for form, mm in MM_BY_UNIT.items())
    return f"""WITH unit(form, mm) AS (VALUES {units}), cell AS (
  SELECT DISTINCT reading_id, receiver_id, unit_text, note, 'h' AS axis, field_h AS header, accuracy_h AS cell FROM accuracy_readings
  UNION SELECT reading_id, receiver_id, unit_text, note, 'v', field_v, accuracy_v FROM accuracy_readings
), piece AS (
  SELECT *, TRY_CAST(TRY_CAST(replace(regexp_extract(cell, {_literal(NUMBER_AND_UNIT)}, 1), ',', '.') AS DOUBLE) AS DECIMAL(22,10)) AS value,
    lower(trim(regexp_replace(regexp_replace(trim(regexp_extract(cell, {_literal(NUMBER_AND_UNIT)}, 2)), '^[(\\[]\\s*|\\s*[)\\]]$', '', 'g'), '\\.$', ''))) AS u,
    lower(trim(regexp_extract(header, {_literal(IN_BRACKETS)}, 1))) AS hu, lower(trim(unit_text)) AS tu, regexp_extract(lower(unit_text), {_literal(IN_PROSE)}, 1) AS pu, regexp_extract(lower(note), {_literal(IN_PROSE)}, 1) AS nu
  FROM cell WHERE cell IS NOT NULL
), read AS (
  SELECT p.reading_id, p.axis, p.value, p.u, a.mm AS in_cell, b.mm AS in_header, coalesce(c.mm, d.mm, e.mm) AS in_row, g.mm AS in_source
  FROM piece p LEFT JOIN unit a ON a.form = p.u LEFT JOIN unit b ON b.form = p.hu LEFT JOIN unit c ON c.form = p.tu LEFT JOIN unit d ON d.form = p.pu LEFT JOIN unit e ON e.form = p.nu
    LEFT JOIN receivers r USING (receiver_id) LEFT JOIN unit g ON g.form = regexp_extract(lower(r.description), {_literal(IN_PROSE)}, 1)
  WHERE p.value > 0 AND (p.u = '' OR a.mm IS NOT NULL)
), said AS (
  SELECT reading_id, axis, value * coalesce(in_cell, in_header, in_row, in_source, 1000) AS exact,
    CASE WHEN in_cell IS NOT NULL THEN 'cell' WHEN in_header IS NOT NULL THEN 'header' WHEN in_row IS NOT NULL THEN 'row' WHEN in_source IS NOT NULL THEN 'source' ELSE 'default' END AS stated_in
  FROM read
)
SELECT {columns} FROM said WHERE exact > 0 AND exact < 1000000"""


_MM = "reading_id, axis, CAST(round(exact, 0) AS BIGINT) AS accuracy_mm"
SQL = {"p4_found": _sql(_MM), "p4_values": _sql(f"{_MM}, stated_in")}
QUERIES = {"p4_found": p4_found, "p4_values": p4_values, "p4_scales": p4_scales}
