"""Quantities recorded in different units onto one unit, through a graph of the notations they are recorded in.

A cell's unit is stated in the cell, in its header, elsewhere in its row or in its device's description, in this order of
nearness. What is said there is a notation, a source of ``unit_graph``; what is measured is a device's channel, an entity: a
device writes one channel in several notations. Notations that name a unit, or an amount of one, are anchors, and so is no
statement at all, for which a default holds. All others (words no table knows) get their unit from the anchors
through the scales between notations of one channel, snapped to a known unit. A notation the graph gives no unit states
nothing, and the next place is asked.

Cells are read once, into a table in the shared folder. Only counts by channel, notation and logarithm meet in a task; the table of notations is broadcast while it is small and
joined by shuffles beyond that.

Defined results
---------------
* NULL or blank cells, placeholders, negative or infinite numbers, numbers followed by what is no unit of length (counts,
  dilution values, by the graph: their spread is not that of the channel): no result row.
* Values not above 0 or not below ``limit_mm``: no result row. Rounding is half up, on exact decimals.
* Repeated rows with one id: one row for each axis. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.functions.lengths import UNITS, cell_number, cell_unit, header_unit, mm_of_unit, prose_unit
from kestrelgrid.operators.components import checkpointed
from kestrelgrid.operators.unit_graph import linked_units, source_levels
from kestrelgrid.sources.derived import written

#: Places a unit is stated in, the nearest first.
PLACES = ("cell", "header", "text", "note", "source")
#: Rows of a table that may be broadcast.
SMALL = 50_000


def read_cells(cells: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, axis, source, value decimal, in_cell .. in_source): the number of each cell and the notation each place has for it, NULL where none."""
    words = cells.where(F.col("cell").isNotNull()).withColumns({"in_note": prose_unit(F.col("note")), "prose": prose_unit(F.col("unit_text"))})
    own = {
        "in_cell": F.lower(cell_unit(F.col("cell"))),
        "in_header": F.lower(header_unit(F.col("header"))),
        "in_text": F.coalesce(F.nullif("prose", F.lit("")), F.lower(F.trim("unit_text"))),
        "in_note": F.col("in_note"),
    }
    said = descriptions.groupBy("source").agg(F.max(prose_unit(F.col("description"))).alias("in_source"))
    read = words.select("id", "axis", "source", cell_number(F.col("cell")).alias("value"), *[F.nullif(c, F.lit("")).alias(n) for n, c in own.items()])
    return read.where("value > 0").join(said.withColumn("in_source", F.nullif("in_source", F.lit(""))), "source", "left")


def notation_units(read: DataFrame, *, default_mm: float = 1000.0, least: int = 5) -> DataFrame:
    """linked_units() of the notations of read_cells()' rows; '' is the notation of a cell without any statement."""
    nearest = F.coalesce(*[f"in_{p}" for p in PLACES], F.lit(""))
    levels = source_levels(read.select(F.concat_ws("|", F.coalesce("source", F.lit("")), "axis").alias("entity"), nearest.alias("source"), F.col("value").cast("double").alias("value")))
    texts = read.select(F.explode(F.array_distinct(F.array(*[f"in_{p}" for p in PLACES]))).alias("source")).where("source IS NOT NULL").distinct()
    named = texts.select("source", mm_of_unit(F.col("source")).cast("double").alias("mm")).where("mm > 0")
    unsaid = levels.sparkSession.createDataFrame([("", default_mm)], "source string, mm double")
    return linked_units(levels, named.unionByName(unsaid), [float(mm) for mm in UNITS], least=least)


def to_millimetres(cells: DataFrame, descriptions: DataFrame, *, default_mm: float = 1000.0, limit_mm: int = 1_000_000) -> DataFrame:
    """cells: (id, axis, source, header, cell, unit_text, note); descriptions: (source, description), one row a source.

    Result: (id, axis, mm bigint, stated_in), the latter ``cell``, ``header``, ``row``, ``source`` or ``default``.
    """
    read = written(read_cells(cells, descriptions))
    units = checkpointed(notation_units(read, default_mm=default_mm).where("mm IS NOT NULL").select("source", F.col("mm").cast("decimal(11,3)").alias("mm")))
    if units.limit(SMALL + 1).count() <= SMALL:
        units = F.broadcast(units)
    for place in PLACES:
        read = read.join(units.select(F.col("source").alias(f"in_{place}"), F.col("mm").alias(f"mm_{place}")), f"in_{place}", "left")
    said = {"cell": "mm_cell", "header": "mm_header", "row": F.coalesce("mm_text", "mm_note"), "source": "mm_source"}
    said = {k: F.col(c) if isinstance(c, str) else c for k, c in said.items()}
    stated = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in said.items()], F.lit("default"))
    mm = F.col("value") * F.coalesce(*said.values(), F.lit(default_mm).cast("decimal(11,3)"))
    return (
        read.where(F.col("in_cell").isNull() | F.col("mm_cell").isNotNull())
        .select("id", "axis", mm.alias("exact"), stated.alias("stated_in"))
        .where((F.col("exact") > 0) & (F.col("exact") < limit_mm))
        .groupBy("id", "axis")
        .agg(F.max(F.struct("exact", "stated_in")).alias("r"))
        .select("id", "axis", F.round("r.exact", 0).cast("bigint").alias("mm"), F.col("r.stated_in").alias("stated_in"))
    )
