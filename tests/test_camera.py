"""Covariances, lenses, angles and texts against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import axis_of, degrees_between, directions_offered, flat, focal_of_view, gravity_error, in_camera, new_direction, pixel, product, rotation_change, semi_axes, settled_share, similar_covariance, turned
from kestrelgrid.functions.tokens import byte_of_share, epoch_seconds, flag, number_or_fraction
from kestrelgrid.plans.camera import tiers_of, useful_baseline

from .test_fits import turn


def lits(values):
    return [F.lit(float(v)) for v in values]


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [row[k] for k in range(len(columns))]


def test_ellipsoids(spark):
    rnd = random.Random(1)
    rows = []
    for k in range(40):
        a = np.array([[rnd.gauss(0, 10 ** rnd.uniform(-2, 2)) for _ in range(3)] for _ in range(3)])
        c = a @ a.T if k else np.eye(3) * 4
        rows.append((k, *(float(c[i, j]) for i, j in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)))))
    names = ["xx", "yy", "zz", "xy", "xz", "yz"]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    cov = [F.col(n) for n in names]
    df = df.withColumns(dict(zip(("s1", "s2", "s3"), semi_axes(*cov)))).withColumns(dict(zip("abc", axis_of(F.col("s1") * F.col("s1"), *cov))))
    for r in df.collect():
        m = np.array([[r.xx, r.xy, r.xz], [r.xy, r.yy, r.yz], [r.xz, r.yz, r.zz]])
        values, vectors = np.linalg.eigh(m)
        assert np.allclose([r.s1, r.s2, r.s3], np.sqrt(np.maximum(values[::-1], 0)), atol=1e-5 * max(1.0, r.s1))
        if values[2] > 1.1 * values[1]:
            assert abs(abs(np.dot(vectors[:, 2], [r.a, r.b, r.c])) - 1) < 1e-6


def test_rotations_and_projection(spark):
    a, b = turn(10, -60, 5), turn(35, -80, -15)
    change, gravity = one(spark, rotation_change(lits(a.ravel()), lits(b.ravel())), gravity_error(lits((b.T @ a).ravel()), lits(a.ravel()), lits(b.ravel())))
    assert abs(change - math.degrees(math.acos((np.trace(a.T @ b) - 1) / 2))) < 1e-6 and gravity < 1e-4
    assert np.allclose(one(spark, *product(lits(a.ravel()), turned(lits(b.ravel())))), (a @ b.T).ravel())
    cov = np.diag([1.0, 4.0, 9.0])
    assert np.allclose(one(spark, *similar_covariance(F.lit(2.0), lits(a.ravel()), lits(cov.ravel()))), (4 * a @ cov @ a.T).ravel())
    centre, point, lens = np.array([1.0, 2.0, 80.0]), np.array([10.0, 20.0, 0.0]), (-0.1, 0.01, 0.001, -0.0005, 0.002)
    seen = a.T @ (point - centre)
    x, y = seen[0] / seen[2], seen[1] / seen[2]
    r2, (k1, k2, p1, p2, k3) = x * x + y * y, lens
    radial = 1 + k1 * r2 + k2 * r2**2 + k3 * r2**3
    want = 1000 * (x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x)) + 500, 900 * (y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y) + 400
    fx, fy, depth = flat(in_camera(lits(a.ravel()), lits(centre), lits(point)))
    assert np.allclose(one(spark, *pixel(fx, fy, lits((1000, 900)), lits((500, 400)), lits(lens)), depth), [*want, seen[2]])
    assert one(spark, *flat(lits((1, 1, -5)))) == [None, None, -5.0]
    assert abs(one(spark, focal_of_view(F.lit(90.0), F.lit(1000.0)))[0] - 500) < 1e-9


def test_new_directions(spark):
    def chosen(worst, seen, path):
        along = F.lit(abs(float(np.dot(worst, seen))))
        return one(spark, *[new_direction(directions_offered(lits(worst), lits(seen), lits(path)), along)[k] for k in "xyz"])

    assert np.allclose(chosen((1, 0, 0), (0, 0, -1), (0, 1, 0)), (1, 0, 0))
    assert np.allclose(chosen((0, 0, 1), (0, 0, -1), (0, 1, 0)), np.cross((0, 0, -1), (0, 1, 0)))
    assert np.allclose(chosen((1, 0, 0), (1, 0, 0), (1, 0, 0)), np.cross((1, 0, 0), (0, 0, 1)))
    assert np.allclose(chosen((0, 0, 1), (0, 0, -1), (0, 0, 1)), (1, 0, 0))
    assert np.allclose(one(spark, settled_share(F.lit(math.pi / 2)), settled_share(F.lit(math.pi / 6)), degrees_between(F.lit(1.5))), (0.9, 0.25, 0.0))


def test_texts(spark):
    assert one(spark, *[flag(F.lit(x)) for x in (" Yes", "TRUE", "0", "y ", None)]) == [True, True, False, True, None]
    assert one(spark, *[number_or_fraction(F.lit(x)) for x in ("1/250", " 2.5 ", "1/0", "x", "1/2/3", None)]) == [0.004, 2.5, None, None, None, None]
    assert one(spark, *[epoch_seconds(F.lit(x)) for x in ("1970-01-01T00:00:01.5", "1970-01-01T01:00:00+01:00", "1970-01-02T00:00:00Z", "soon", None)]) == [1.5, 0.0, 86400.0, None, None]
    assert one(spark, *[byte_of_share(F.lit(x)) for x in (-1.0, 0.5, 2.0, None)]) == [0, 128, 255, None]


def test_tiers_and_baselines(spark):
    df = spark.createDataFrame([(0.9, 2.0), (0.5, 0.0), (0.1, 1.0), (None, None)], "a double, b double")
    got = [(r.a_tier, r.b_tier) for r in tiers_of(tiers_of(df, "a"), "b").collect()]
    assert got == [(2, 2), (1, 0), (0, 1), (None, None)]
    base = lambda *v: useful_baseline(*[F.lit(x) for x in v])
    assert one(spark, base(0.2, 1.0, True, 1.0, 0.1), base(5.0, 0.001, True, 1.0, 0.1), base(5.0, None, True, 1.0, 0.1), base(1.0, 1.0, False, 1.0, 0.1), base(5.0, 1.0, False, 0.01, 0.9), base(5.0, 1.0, False, 0.2, 0.9)) == [0, 0, 5, 0, 0, 5]
