import random

from pyspark.sql import functions as F

from kestrelgrid.operators.components import components
from kestrelgrid.operators.coverage import greedy_views
from kestrelgrid.operators.grid import consensus, counted_median, fill_nearest, nearest_rank, radius_outliers, raster_cells
from kestrelgrid.operators.vector_search import count_within, nearest


def test_radius_outliers(spark):
    rnd = random.Random(1)
    pts = [("f", k, rnd.gauss(0, 3), rnd.gauss(0, 3), rnd.gauss(0, 1)) for k in range(150)] + [("f", 1000 + k, 0.5, 0.5, 0.5) for k in range(40)] + [("f", 2000, 99.0, 0.0, 0.0)]
    want = {a[1] for a in pts if sum(b is not a and sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) <= 1.5**2 for b in pts) >= 3}
    df = spark.createDataFrame(pts, "f string, id bigint, x double, y double, z double")
    got = [r.id for r in radius_outliers(df, ["f"], "id", 1.5, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert radius_outliers(df.limit(0), ["f"], "id", 1.5, 3).count() == 0


def test_percentiles(spark):
    rnd = random.Random(3)
    data = {k: [rnd.randrange(50) for _ in range(n)] for k, n in (("a", 101), ("b", 4), ("c", 1))}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("a", None)], "k string, v bigint")
    got = {r.k: (r.n, r.p10, r.p90) for r in nearest_rank(df, ["k"], "v", {"p10": 10, "p90": 90}).collect()}
    for k, vs in data.items():
        s = sorted(vs)
        assert got[k] == (len(s), s[round((len(s) - 1) * 0.1)], s[round((len(s) - 1) * 0.9)])
    mid = {r.k: r.m for r in counted_median(df, ["k"], "v").collect()}
    assert mid == {k: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2 for k, v in data.items()}


def test_consensus_ties_go_low(spark):
    votes = spark.createDataFrame([("a", 0), ("a", 400), ("a", 5000), ("a", 5400), ("b", 7)], "k string, z bigint")
    assert {r.k: (r.z_mean, r.n_agree) for r in consensus(votes, ["k"], 500).collect()} == {"a": (200.0, 2), "b": (7.0, 1)}


def test_cells_are_clipped(spark):
    df = spark.createDataFrame([("f", 0.0, 0.0), ("f", 10.0, 10.0), ("f", 4.9, 9.9), ("g", 1.0, 1.0)], "f string, x double, y double")
    got = {(r.f, r.x): (r.row, r.col) for r in raster_cells(df, ["f"], 5.0).collect()}
    assert got == {("f", 0.0): (1, 0), ("f", 10.0): (0, 1), ("f", 4.9): (0, 0), ("g", 1.0): (0, 0)}


def test_fill(spark):
    cells = spark.createDataFrame([("f", 0, 0, 1.0), ("f", 0, 4, 2.0), ("f", 3, 0, 3.0)], "f string, row bigint, col bigint, z double")
    got = {(r.row, r.col): (r.z, r.filled) for r in fill_nearest(cells, ["f"], "z", 2).collect()}
    assert got[0, 2] == (1.0, True) and got[0, 3] == (2.0, True) and got[0, 0] == (1.0, False) and got[2, 0] == (3.0, True) and (3, 4) not in got and (2, 3) not in got


def test_components(spark):
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 60)] + [(200 + rnd.randrange(40), 200 + rnd.randrange(40)) for _ in range(25)] + [(5, 5), (900, 900), (None, 1)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.v: r.component for r in components(df).collect()} == {v: root(v) for v in list(parent)}
    assert components(df.limit(0)).count() == 0


def test_vectors(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.random() for _ in range(4)]) for k in range(60)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 4), (103, [0.5] * 4), (104, [0.5] * 4)]
    good = {k: v for k, v in rows if v and len(v) == 4 and v[0] == v[0]}
    df = spark.createDataFrame(rows, "id bigint, vector array<double>")
    asked = df.where("id IN (0, 10, 103, 100)")
    dist = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(a, b)) ** 0.5, 6)
    got = {(r.q, r["rank"]): r.id for r in nearest(df, asked, 3, block=2).collect()}
    for q in (0, 10, 103):
        want = sorted((dist(good[q], v), k) for k, v in good.items() if k != q)
        assert [got[q, i + 1] for i in range(3)] == [k for _, k in want[:3]]
    assert {r.q: r.n for r in count_within(df, asked, 0.4, block=1).collect()} == {q: n for q in (0, 10, 103) if (n := sum(dist(good[q], v) <= 0.4 for k, v in good.items() if k != q))}
    assert nearest(df.limit(0), asked, 2).count() == 0 and nearest(df, asked.limit(0), 2).count() == 0


def test_greedy_views(spark):
    rnd = random.Random(4)
    views = {(f, v): {(rnd.randrange(5), rnd.randrange(5)) for _ in range(6)} for f in "ab" for v in range(40)}
    want, seen = set(), {}
    for (f, v), cells in sorted(views.items()):
        own = seen.setdefault(f, {})
        if sum(own.get(c, 0) < 2 for c in cells) >= 0.4 * len(cells):
            want.add((f, v))
            for c in cells:
                own[c] = own.get(c, 0) + 1
    rows = [(f, v, i, j) for (f, v), cells in views.items() for i, j in cells]
    df = spark.createDataFrame(rows + rows[:5] + [(None, 1, 1, 1), ("a", None, 1, 1), ("a", 1, None, 1)], "flight_id string, view bigint, i bigint, j bigint")
    assert {(r.flight_id, r.view) for r in greedy_views(df, target=2).collect()} == want
    assert greedy_views(df.limit(0)).count() == 0
