"""Units of sources from what they measured together with sources whose unit is known.

A source is any way a quantity is recorded, a notation as well as a device; an entity is what was measured. In each entity
the sources are linked with its hub, the source with most readings (of those with a known unit, if there are any), so an
entity of k sources gives k - 1 links and every two of its sources are joined through the hub. The scale of a pair is the
weighted median, over its entities, of the difference of the medians of the logarithms, counted on a resolution of a
thousandth; its standard error follows from the readings on both sides and their median absolute deviation; its offset is
the median difference that is left, as a share of the level.

Units go from the known sources along the links. A source's estimate combines all its links to sources known so far and
is snapped to the known unit that explains it best: the likelihood of the estimate times how often the unit is used among
the readings of known sources, if that is at least ``sure`` of the sum over all units. A pair whose spreads differ, or whose offset isn't small, measures different things and is
no link; a source with too few readings, or an estimate between units or beside all of them, stays unknown.

Defined results
---------------
* Values that aren't above 0 and finite, NULL entities or sources: not used. Repeated rows weigh as often as they come.
* Sources of fewer than ``least`` readings, or that no link reaches: mm NULL. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgrid.operators.components import checkpointed

_STEPS = 1000
#: Standard error of a median in deviations of the readings, and of a deviation in medians of absolute deviations.
_MEDIAN_ERROR, _DEVIATION = 1.2533, 1.4826
#: Largest ratio of the spreads of two sources of one quantity, and largest offset as a share of the level.
MOST_SPREAD, MOST_OFFSET = 2.5, 0.5


def weighted_median(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """(by, m): the least whole-number value at which half the weight is reached; weights are summed by value before they meet."""
    w = Window.partitionBy(*by)
    n = df.groupBy(*by, value).agg(F.sum(weight).alias("__w"))
    n = n.withColumns({"__upto": F.sum("__w").over(w.orderBy(value)), "__all": F.sum("__w").over(w)})
    return n.where(F.col("__upto") * 2 >= F.col("__all")).groupBy(*by).agg(F.min(value).alias("m"))


def source_levels(readings: DataFrame) -> DataFrame:
    """readings: (entity, source, value). Result: (entity, source, n, m, spread): the median of 1000 log value and the median absolute deviation."""
    sound = readings.where((F.col("value") > 0) & (F.col("value") < float("inf")) & F.col("entity").isNotNull() & F.col("source").isNotNull())
    counts = sound.select("entity", "source", F.round(F.log("value") * _STEPS).cast("bigint").alias("q")).groupBy("entity", "source", "q").agg(F.count("*").alias("n"))
    m = counts.groupBy("entity", "source").agg(F.sum("n").alias("n"), F.percentile("q", F.lit(0.5), F.col("n")).alias("m"))
    off = counts.withColumnRenamed("n", "k").join(m, ["entity", "source"]).withColumn("d", F.abs(F.col("q") - F.col("m")))
    return off.groupBy("entity", "source").agg(F.first("n").alias("n"), F.first("m").alias("m"), F.percentile("d", F.lit(0.5), F.col("k")).alias("spread"))


def pair_scales(levels: DataFrame, anchors: DataFrame) -> DataFrame:
    """levels: what source_levels() gives; anchors: (source, mm). Result: (a, b, entities, n_a, n_b, log_scale, error, spread_ratio, offset).

    a is the hub; log_scale is of b's values over a's, error its standard error, offset a share of b's level.
    """
    known = anchors.select("source", F.lit(True).alias("known")).distinct()
    rank = F.struct(F.coalesce("known", F.lit(False)).alias("known"), "n", "source", "m", "spread")
    hubs = levels.join(known, "source", "left").groupBy("entity").agg(F.max(rank).alias("h"))
    linked = levels.join(hubs, "entity").where(F.col("source") != F.col("h.source"))
    linked = linked.select(
        F.col("h.source").alias("a"), F.col("source").alias("b"), F.col("h.n").alias("n_a"), F.col("n").alias("n_b"), F.col("h.m").alias("m_a"), F.col("m").alias("m_b"),
        F.col("h.spread").alias("spread_a"), F.col("spread").alias("spread_b"),
        F.round(F.col("m") - F.col("h.m")).cast("bigint").alias("d"), (F.col("h.n") * F.col("n") / (F.col("h.n") + F.col("n"))).alias("w"),
    )
    mid = weighted_median(linked, ["a", "b"], "d", "w").withColumnRenamed("m", "s")
    left = linked.join(mid, ["a", "b"])
    left = left.withColumn("o", F.round((1 - F.exp((F.col("s") + F.col("m_a") - F.col("m_b")) / _STEPS)) * _STEPS).cast("bigint"))
    offset = weighted_median(left, ["a", "b"], "o", "w").select("a", "b", (F.col("m") / _STEPS).alias("offset"))
    mean = lambda c, n: F.sum(F.col(c) * F.col(n)) / F.sum(n)
    pairs = left.groupBy("a", "b").agg(
        F.count("*").alias("entities"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.first("s").alias("s"), F.sum("w").alias("w"),
        mean("spread_a", "n_a").alias("spread_a"), mean("spread_b", "n_b").alias("spread_b"),
    )
    error = _MEDIAN_ERROR * _DEVIATION * F.greatest("spread_a", "spread_b") / _STEPS / F.sqrt("w")
    return pairs.join(offset, ["a", "b"]).select(
        "a", "b", "entities", "n_a", "n_b", (F.col("s") / _STEPS).alias("log_scale"), F.greatest(error, F.lit(1 / _STEPS)).alias("error"),
        ((F.col("spread_b") + 1) / (F.col("spread_a") + 1)).alias("spread_ratio"), "offset",
    )


def _estimates(links: DataFrame, known: DataFrame) -> DataFrame:
    """(source, log_mm, error): what the links of each source to known ones say together, by inverse variance."""
    w = 1 / (F.col("error") * F.col("error"))
    said = links.join(known.select(F.col("source").alias("a"), "mm"), "a").withColumn("says", F.log("mm") - F.col("log_scale"))
    return said.groupBy(F.col("b").alias("source")).agg((F.sum(w * F.col("says")) / F.sum(w)).alias("log_mm"), (1 / F.sqrt(F.sum(w))).alias("error"))


def _snapped(estimate: Column, error: Column, usage: dict[float, float], sure: float) -> Column:
    """The unit that explains an estimate best; NULL where its share of all explanations is below ``sure`` or it is over four errors away."""
    choices = [
        F.struct((F.lit(math.log(use)) - F.pow((estimate - F.lit(math.log(mm))) / error, 2) / 2).alias("fit"), F.abs(estimate - F.lit(math.log(mm))).alias("gap"), F.lit(mm).alias("mm"))
        for mm, use in sorted(usage.items())
    ]
    best = F.array_max(F.array(*choices))
    against = sum((F.exp(c.getField("fit") - best.getField("fit")) for c in choices), F.lit(0.0))
    return F.when((1 / against >= sure) & (best.getField("gap") <= 4 * error), best.getField("mm"))


def linked_units(levels: DataFrame, anchors: DataFrame, units_mm: list[float], *, least: int = 5, sure: float = 0.9) -> DataFrame:
    """levels: what source_levels() gives; anchors: (source, mm double), one row a source. Result: one row for each source.

    (source, readings, anchor_mm, linked_mm, error, snapped_mm, mm, hops): what its links say (NULL without links), the unit
    that is snapped to, and the unit that holds: the anchor's with 0 hops, else the snapped one. Anchors get linked_mm and
    snapped_mm too, from their links to other anchors, as a check.
    """
    anchors = checkpointed(anchors.where("mm > 0").groupBy("source").agg(F.min("mm").alias("mm")))
    levels = checkpointed(levels)
    pairs = checkpointed(pair_scales(levels, anchors))
    ok = pairs.where((F.col("spread_ratio") <= MOST_SPREAD) & (F.col("spread_ratio") >= 1 / MOST_SPREAD) & (F.abs("offset") <= MOST_OFFSET) & (F.least("n_a", "n_b") >= least))
    e = ok.select("a", "b", "log_scale", "error")
    e = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("log_scale")).alias("log_scale"), "error"))
    # how often each of the known units is used: a handful of numbers, one for each unit
    used = {r.mm: r.n for r in levels.join(anchors, "source").where(F.col("mm").isin(units_mm)).groupBy("mm").agg(F.sum("n").alias("n")).collect()}
    usage = {mm: (used.get(mm, 0) + 1) / (sum(used.values()) + len(units_mm)) for mm in units_mm}
    known, hop = anchors.withColumn("hops", F.lit(0)), 0
    first = checkpointed(_estimates(e, anchors).withColumn("snapped", _snapped(F.col("log_mm"), F.col("error"), usage, sure)))
    linked = first
    while True:
        hop += 1
        fresh = linked.where("snapped IS NOT NULL").join(known.select("source"), "source", "left_anti")
        fresh = checkpointed(fresh.select("source", F.col("snapped").alias("mm"), F.lit(hop).alias("hops"), "log_mm", "error"))
        if not fresh.limit(1).count():
            break
        told = fresh if hop == 1 else told.unionByName(fresh)
        known = checkpointed(known.unionByName(fresh.select("source", "mm", "hops")))
        linked = _estimates(e, known).withColumn("snapped", _snapped(F.col("log_mm"), F.col("error"), usage, sure))
    said = first
    if hop > 1:
        # later hops have their own estimate
        later = told.where("hops > 1").select("source", "log_mm", "error", F.col("mm").alias("snapped"))
        said = said.join(later.select("source"), "source", "left_anti").unionByName(later)
    sources = levels.groupBy("source").agg(F.sum("n").alias("readings"))
    every = sources.join(anchors.withColumnRenamed("mm", "anchor_mm"), "source", "left").join(said, "source", "left").join(known.select("source", "mm", "hops"), "source", "left")
    return every.select("source", "readings", "anchor_mm", F.exp("log_mm").alias("linked_mm"), "error", F.col("snapped").alias("snapped_mm"), "mm", "hops")
