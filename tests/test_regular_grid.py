"""The grid against a cell-by-cell reading of the rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import millis
from kestrelgrid.operators.regular_grid import regular_grid

READ = "s string, t_ms bigint, step_ms bigint, value double, rank bigint, value2 double"
SPAN = "s string, step_ms bigint, lo_ms bigint, hi_ms bigint"


def brute(readings, spans, hold):
    out = {}
    for s, step, lo, hi in spans:
        if s is None or lo is None or hi is None or not step or step <= 0:
            continue
        points = {}
        for rs, t, st, v, rank, _ in readings:
            if rs == s and t is not None and st:
                points.setdefault(t, []).append((rank, v))
        times = sorted(points)
        for k in range(math.ceil(lo / step), math.floor(hi / step)):
            a, b = k * step, (k + 1) * step
            n, ms, w = 0, 0, 0.0
            for i, t in enumerate(times):
                if a <= t < b:
                    n += len(points[t])
                v = max(points[t], key=lambda x: x[0])[1]
                end = min(times[i + 1] if i + 1 < len(times) else t + hold * step, t + hold * step)
                if v is not None and not math.isnan(v):
                    o = max(0, min(end, b) - max(t, a))
                    ms, w = ms + o, w + v * o
            out[s, a] = (n, ms, None if not ms else round(w / ms, 9), "observed" if n else "held" if ms else "missing")
    return out


def run(spark, readings, spans, **kw):
    g = regular_grid(spark.createDataFrame(readings, READ), spark.createDataFrame(spans, SPAN), source="s", **kw)
    rows = g.collect()
    found = {(r.s, r.cell_start_ms): (r.n_samples, r.covered_ms, None if r.mean_value is None else round(r.mean_value, 9), r.status) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    readings, spans = [], []
    for s, step in (("a", 100), ("b", 250), ("c", 1000)):
        for _ in range(60):
            t = rnd.randrange(-3000, 12000)
            readings.append((s, t, step, rnd.choice([None, float("nan"), rnd.random() * 10, 5.0]), len(readings), 1.0))
        readings += readings[-3:]  # ties: the last rank's value counts, all count as samples
        spans += [(s, step, -2500, 3333), (s, step, 3000, 9999), (s, step, 50, 60)]
    assert run(spark, readings, spans, chunk_cells=7) == brute(readings, spans, 2)


def test_nulls_and_empty(spark):
    readings = [(None, 5, 10, 1.0, 1, 1.0), ("a", None, 10, 1.0, 1, 1.0), ("b", 5, None, 1.0, 1, 1.0)]
    assert run(spark, readings, [("a", 10, None, 50), ("a", 10, 0, None), ("a", None, 0, 50), (None, 10, 0, 50)]) == {}
    found = run(spark, readings, [("a", 10, 0, 30)])
    assert set(found) == {("a", 0), ("a", 10), ("a", 20)} and {x[3] for x in found.values()} == {"missing"}
    assert run(spark, [], [("a", 10, 0, 30)]).keys() == found.keys()
    assert run(spark, readings, []) == {}


def test_hot_source_is_split(spark):
    readings = [("hot", 10 * k, 10, float(k), k, 0.0) for k in range(5000)]
    found = run(spark, readings, [("hot", 10, 0, 50000)], chunk_cells=64)
    assert len(found) == 5000 and all(x[0] == 1 and x[1] == 10 for x in found.values())


def test_millis(spark):
    values = [1.0004, 1.0005, -0.25, float("nan"), float("inf"), 1e300, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(millis(F.col("v"))).collect()]
    assert got == [1000, 1001, -250, None, None, None, None]


def test_bad_parameters(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], hold_cells=0)
