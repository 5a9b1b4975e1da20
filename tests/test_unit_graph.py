import random

from pyspark.sql import functions as F

from kestrelgrid.operators.unit_graph import linked_units, source_levels

MM = {"a": 1000.0, "b": 1.0, "c": 304.8, "d": 10.0}
UNITS = sorted(set(MM.values()) | {25.4, 914.4, 0.001, 1e6, 100.0})


def readings(spark, extra=()):
    rnd = random.Random(2)
    rows = []
    for k in range(40):
        true = 10 ** rnd.uniform(2, 4)  # mm
        # a and d never meet: d is reached through b or c
        for s in ("ab", "bc", "cd")[k % 3]:
            rows += [(f"x{k}", s, true / MM[s] * rnd.lognormvariate(0, 0.4), 0) for _ in range(60)]
    rows += [("lone", "e", 3.0, 0), ("x1", None, 1.0, 0), (None, "a", 1.0, 0), ("x1", "a", None, 0), ("x1", "a", float("nan"), 0), ("x1", "a", -1.0, 0), *extra]
    return spark.createDataFrame(rows, "entity string, source string, value double, mm int")


def units(spark, rows, anchors):
    found = linked_units(source_levels(rows), spark.createDataFrame(anchors, "source string, mm double"), UNITS)
    return {r.source: (r.mm, r.hops) for r in found.collect()}


def test_units_reach_every_linked_source(spark):
    got = units(spark, readings(spark), [("a", 1000.0), ("a", 1000.0)])
    assert got == {"a": (1000.0, 0), "b": (1.0, 1), "c": (304.8, 2), "d": (10.0, 3), "e": (None, None)}


def test_anchors_are_checked_by_their_links(spark):
    found = linked_units(source_levels(readings(spark)), spark.createDataFrame([("a", 1000.0), ("b", 1.0), ("c", 25.4)], "source string, mm double"), UNITS)
    got = {r.source: (r.anchor_mm, r.snapped_mm) for r in found.collect()}
    assert got["a"] == (1000.0, 1000.0) and got["c"] == (25.4, 304.8)


def test_what_measures_something_else_gets_no_unit(spark):
    rnd = random.Random(3)
    counts = [(f"x{k}", "sats", 12.0, 0) for k in range(40) for _ in range(9)]
    few = [("x0", "rare", 5.0, 0)] * 4
    odd = [(f"x{k}", "odd", rnd.lognormvariate(9, 0.4), 0) for k in range(0, 40, 3) for _ in range(60)]
    got = units(spark, readings(spark, counts + few + odd), [("a", 1000.0), ("b", 1.0), ("c", 304.8), ("d", 10.0)])
    assert got["sats"] == got["rare"] == got["odd"] == (None, None)


def test_nothing_to_link(spark):
    df = readings(spark)
    assert units(spark, df.limit(0), [("a", 1000.0)]) == {}
    assert units(spark, df.where(F.col("source") == "b"), [("a", 1000.0)]) == {"b": (None, None)}
