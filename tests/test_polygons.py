"""Polygons against reading edges one by one."""

import random

from kestrelgrid.operators.polygons import inside, polygon_areas


def test_polygons(spark):
    rnd = random.Random(6)
    rings = {"star": [(rnd.uniform(-100, 100), rnd.uniform(-100, 100)) for _ in range(9)], "box": [(0, 0), (10, 0), (10, 10), (0, 10)], "line": [(0, 0), (5, 5)]}
    rows = [(k, s, float(x), float(y), 1) for k, ring in rings.items() for s, (x, y) in enumerate(ring)] + [("box", 9, None, 1.0, 1)]
    corners = spark.createDataFrame(rows, "k string, s int, x double, y double, n int")
    asked = [(k, i, rnd.uniform(-110, 110), rnd.uniform(-110, 110)) for k in rings for i in range(400)] + [("box", 900, 5.0, 5.0), ("box", 901, 0.0, 5.0), ("none", 1, 0.0, 0.0)]
    points = spark.createDataFrame(asked, "k string, i int, x double, y double")

    def odd(ring, x, y):
        n = 0
        for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]):
            n += (b > y) != (d > y) and x >= a + (y - b) / (d - b) * (c - a)
        return n % 2 == 1 and len(ring) > 2

    got = {(r.k, r.i) for r in inside(points, corners, ["k"], "s", 7.0).collect()}
    assert got == {(k, i) for k, i, x, y in asked if k in rings and odd(rings[k], x, y)} and ("box", 900) in got
    areas = {r.k: (r.n, round(r.area, 6), round(r.length, 6)) for r in polygon_areas(corners, ["k"], "s").collect()}
    ring = rings["star"]
    assert areas["box"] == (4, 100.0, 40.0) and areas["line"] == (2, 0.0, 0.0)
    assert areas["star"][1] == round(abs(sum(a * d - b * c for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))) / 2, 6)
    assert inside(points, corners.limit(0), ["k"], "s", 7.0).count() == 0 and polygon_areas(corners.limit(0), ["k"], "s").count() == 0
