"""Irregular readings onto a regular grid, by validity intervals.

Each reading holds from its own time until the next reading of its source, but at most ``hold_cells`` grid cells. These
step-function intervals are cut at the borders of the cells; a cell's value is the time-weighted average over what
covers it, and its coverage the covered fraction. Cells are those lying wholly in one of the source's spans.

Work is split by (source, run of ``chunk_cells`` cells), so a source with a third of all readings is spread over many
tasks. A reading near a run's border is copied to the neighbouring run (``hold_cells`` + 1 cells on either side), which
makes every run complete in itself: spans and readings meet in one shuffle, and nothing is joined.

Defined results
---------------
* Readings whose time is NULL, NaN, infinite or beyond the clock limit, or whose source has no grid step: not used.
* Several readings of a source at one millisecond: the latest ``rank`` column's value counts, all are counted in
  ``n_samples``.
* NULL or NaN values: the reading counts as present, but its interval gives no value (a gap in ``covered``).
* Spans with a NULL border, or shorter than a cell: no cells. Overlapping spans: each cell once.
* Sources without readings: all their cells are missing. Sources without spans: no rows. Empty tables: no rows.
* Columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import floor_div


def regular_grid(
    readings: DataFrame,
    spans: DataFrame,
    *,
    source: str,
    hold_cells: int = 2,
    chunk_cells: int = 1024,
) -> DataFrame:
    """One row per cell of each source's spans.

    readings: (``source``, t_ms bigint, step_ms bigint, value double, rank any orderable).
    spans: (``source``, step_ms bigint, lo_ms bigint, hi_ms bigint); step_ms must be the same for all rows of a source.
    Result: (``source``, cell_start_ms, n_samples, covered_ms, coverage, mean_value, status); status is ``observed`` (a
    reading falls in the cell), ``held`` (filled by an earlier reading) or ``missing`` (nothing known; mean_value NULL).
    """
    if hold_cells < 1 or chunk_cells <= hold_cells:
        raise ValueError("hold_cells must be at least 1 and below chunk_cells")
    step, t, cell = F.col("step_ms").cast("bigint"), F.col("t_ms"), F.col("cell")
    chunk = F.floor(cell / chunk_cells).cast("bigint")
    near = F.lit(hold_cells + 1)
    own = chunk.alias("own")
    r = (
        readings.where(t.isNotNull() & (step > 0) & F.col(source).isNotNull())
        .select(source, t.alias("t_ms"), step.alias("step_ms"), F.col("value").cast("double"), "rank")
        .withColumn("cell", floor_div(F.col("t_ms"), F.col("step_ms")))
        .withColumn("own", own)
        .withColumn("chunk", F.explode(F.array_distinct(F.array(F.col("own"), _chunk(cell - near, chunk_cells), _chunk(cell + near, chunk_cells)))))
        .select(source, "chunk", "step_ms", "t_ms", F.struct("rank", "value").alias("last"), (F.col("chunk") == F.col("own")).alias("is_own"), _null("bigint", "lo"), _null("bigint", "hi"))
    )
    s = (
        spans.where(F.col("lo_ms").isNotNull() & F.col("hi_ms").isNotNull() & (step > 0) & F.col(source).isNotNull())
        .select(source, step.alias("step_ms"), (-floor_div(-F.col("lo_ms"), step)).alias("first"), (floor_div(F.col("hi_ms"), step) - 1).alias("final"))
        .where(F.col("final") >= F.col("first"))
        .withColumn("chunk", F.explode(F.sequence(_chunk(F.col("first"), chunk_cells), _chunk(F.col("final"), chunk_cells))))
        .withColumn("lo", F.greatest("first", F.col("chunk") * chunk_cells))
        .withColumn("hi", F.least("final", (F.col("chunk") + 1) * chunk_cells - 1))
    )
    s = s.select(source, "chunk", "step_ms", _null("bigint", "t_ms"), F.lit(None).cast(r.schema["last"].dataType).alias("last"), F.lit(True).alias("is_own"), "lo", "hi")
    # hash(source, chunk) also serves the finer groups and the window below: this is the only shuffle
    both = r.unionByName(s).repartition(source, "chunk")
    points = both.groupBy(source, "chunk", "t_ms", "lo", "hi").agg(
        F.first("step_ms").alias("step_ms"), F.max("last").getField("value").alias("value"), F.first("is_own").alias("is_own"), F.count("last").alias("n")
    )
    # spans have no t_ms and sort before every reading, so they are never the next reading of one
    w = Window.partitionBy(source, "chunk").orderBy(F.col("t_ms").asc_nulls_first())
    held = points.withColumn("next_ms", F.lead("t_ms").over(w)).withColumn("end_ms", F.least(F.col("next_ms"), F.col("t_ms") + F.col("step_ms") * hold_cells))
    at = floor_div(F.col("t_ms"), F.col("step_ms"))
    last = floor_div(F.col("end_ms") - 1, F.col("step_ms"))
    cells = (
        held.withColumn("at", at)
        .withColumn("cell", F.explode(F.when(F.col("t_ms").isNull(), F.sequence("lo", "hi")).otherwise(F.sequence(F.col("at"), F.greatest(F.col("at"), last)))))
        .where(chunk == F.col("chunk"))
        .withColumn("from_ms", F.greatest(F.col("t_ms"), cell * F.col("step_ms")))
        .withColumn("till_ms", F.least(F.col("end_ms"), (cell + 1) * F.col("step_ms")))
        .withColumn("ms", F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("till_ms") - F.col("from_ms")))
        .groupBy(source, "chunk", "cell")
        .agg(
            F.first("step_ms").alias("step_ms"),
            F.max(F.col("t_ms").isNull()).alias("in_span"),
            F.sum(F.when(F.col("is_own") & (cell == F.col("at")), F.col("n")).otherwise(0)).alias("n_samples"),
            F.coalesce(F.sum("ms"), F.lit(0)).alias("covered_ms"),
            F.sum(F.col("value") * F.col("ms")).alias("weighted"),
        )
        .where("in_span")
    )
    return cells.select(
        source,
        (cell * F.col("step_ms")).alias("cell_start_ms"),
        "n_samples",
        "covered_ms",
        (F.col("covered_ms") / F.col("step_ms")).alias("coverage"),
        F.when(F.col("covered_ms") > 0, F.col("weighted") / F.col("covered_ms")).alias("mean_value"),
        F.when(F.col("n_samples") > 0, "observed").when(F.col("covered_ms") > 0, "held").otherwise("missing").alias("status"),
    )


def _chunk(cell: Column, size: int) -> Column:
    return F.floor(cell / size).cast("bigint")


def _null(kind: str, name: str) -> Column:
    return F.lit(None).cast(kind).alias(name)
