"""Similarities, tracks and triangulation against numpy and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import gimbal_rotation
from kestrelgrid.operators.similarity import R, known_rotation_fits, robust_similarity, similarity_fits
from kestrelgrid.operators.tracks import build_tracks
from kestrelgrid.operators.triangulation import triangulate, widest_angles

PAIR = "g string, id bigint, x double, y double, z double, u double, v double, w double, scale int"


def turn(yaw, pitch, roll):
    """Rotation by three axes, composed of single ones."""
    a, b, c = np.radians([yaw, pitch, roll])
    z = lambda t: np.array([[math.cos(t), -math.sin(t), 0], [math.sin(t), math.cos(t), 0], [0, 0, 1]])
    x = np.array([[1, 0, 0], [0, math.cos(b), -math.sin(b)], [0, math.sin(b), math.cos(b)]])
    return z(a) @ np.array([[1, 0, 0], [0, 0, 1], [0, -1, 0]]) @ x @ z(c)


def moved(key, n, scale, m, shift, rnd, noise=0.0, wrong=0):
    rows = []
    for k in range(n):
        p = np.array([rnd.uniform(-50, 50) for _ in range(3)])
        q = scale * m @ p + shift + np.array([rnd.gauss(0, noise) for _ in range(3)])
        if k < wrong:
            q += np.array([rnd.uniform(-200, 200) for _ in range(3)])
        rows.append((key, k, *map(float, p), *map(float, q), 0))
    return rows


def test_similarities(spark):
    rnd = random.Random(1)
    m, s = turn(40, -70, 10), np.array([5.0, -3.0, 100.0])
    rows = moved("a", 200, 1.7, m, s, rnd) + [("b", k, float(k), 0.0, 0.0, 2.0 * k, 1.0, 0.0, 0) for k in range(5)] + [("c", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0)] * 2
    rows += [("a", 900, None, 1.0, 1.0, 1.0, 1.0, 1.0, 0), ("a", 901, float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, PAIR)
    got = {r.g: r for r in similarity_fits(df, ["g"]).collect()}
    assert set(got) == {"a", "b"} and got["b"].degenerate and not got["a"].degenerate and got["a"].n == 200
    assert abs(got["a"].scale - 1.7) < 1e-9 and got["a"].rmse < 1e-5
    assert np.allclose([got["a"][r] for r in R], m.ravel()) and np.allclose([got["a"].tx, got["a"].ty, got["a"].tz], s)
    assert similarity_fits(df.limit(0), ["g"]).count() == 0
    known = df.where("g = 'a'").withColumns({r: F.lit(float(v)) for r, v in zip(R, m.ravel())})
    k = known_rotation_fits(known, ["g"]).first()
    assert abs(k.scale - 1.7) < 1e-9 and np.allclose([k.tx, k.ty, k.tz], s)
    assert known_rotation_fits(known.where("id = 1"), ["g"]).first().scale is None and known_rotation_fits(known, ["g"], scale=1.0).first().scale == 1.0


def test_reflections_become_rotations(spark):
    rnd = random.Random(2)
    rows = moved("a", 50, 1.0, np.diag([1.0, 1.0, -1.0]), np.zeros(3), rnd)
    got = similarity_fits(spark.createDataFrame(rows, PAIR), ["g"]).first()
    assert abs(np.linalg.det(np.array([got[r] for r in R]).reshape(3, 3)) - 1) < 1e-9


def test_consensus(spark):
    rnd = random.Random(3)
    m, s = turn(-20, 15, 60), np.array([1.0, 2.0, 3.0])
    rows = moved("a", 400, 0.8, m, s, rnd, noise=0.05, wrong=160) + moved("few", 4, 2.0, m, s, rnd)
    got = {r.g: r for r in robust_similarity(spark.createDataFrame(rows, PAIR), ["g"], "id", within=1.0).collect()}
    assert got["a"].total == 400 and 236 <= got["a"].inliers <= 244 and abs(got["a"].scale - 0.8) < 0.001 and got["a"].rmse < 0.2
    assert abs(got["few"].scale - 2) < 1e-6


def chained(matches):
    """Tracks by taking every match in order, whatever it is connected with."""
    group = {}
    for fa, ka, fb, kb, _ in sorted(set(matches), key=lambda m: (m[4], (m[0] << 40) + m[1], (m[2] << 40) + m[3])):
        a, b = group.setdefault((fa, ka), {(fa, ka)}), group.setdefault((fb, kb), {(fb, kb)})
        if a is not b and len({f for f, _ in a | b}) == len(a | b):
            a |= b
            for node in b:
                group[node] = a
    return {frozenset(g) for g in group.values() if len(g) > 1}


def test_tracks(spark):
    rnd = random.Random(4)
    matches = [(0, 0, 1, 5, 1), (1, 5, 2, 2, 2), (0, 1, 2, 2, 3)]
    matches += [(f, 100 + k, f + 1, 100 + k, 10 + f) for k in range(5) for f in range(6)]
    matches += [(f, 200 + rnd.randrange(8), f + rnd.randrange(1, 3), 200 + rnd.randrange(8), rnd.randrange(1000)) for f in range(8) for _ in range(6)]
    df = spark.createDataFrame(matches + matches[:9] + [(None, 1, 2, 3, 4)], "fa int, ka bigint, fb int, kb bigint, place bigint")
    got = {}
    for r in build_tracks(df).collect():
        got.setdefault(r.track, set()).add((r.frame, r.key))
    assert {frozenset(g) for g in got.values()} == chained(matches)
    assert frozenset({(0, 0), (1, 5), (2, 2)}) in chained(matches)
    assert build_tracks(df.limit(0)).count() == 0


def test_triangulation(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for t in range(30):
        want[t] = np.array([rnd.uniform(-30, 30), rnd.uniform(-30, 30), rnd.uniform(-5, 5)])
        for k in range(2 + t % 4):
            c, m = np.array([rnd.uniform(-80, 80), rnd.uniform(-80, 80), rnd.uniform(60, 120)]), turn(rnd.uniform(-180, 180), -90 + rnd.uniform(-20, 20), 0)
            seen = m.T @ (want[t] - c)
            rows.append((t, k, *map(float, c), *map(float, m.ravel()), float(seen[0] / seen[2]), float(seen[1] / seen[2])))
    rows += [(90, 0, *rows[0][2:]), (91, 0, *rows[0][2:]), (91, 1, *rows[0][2:]), (92, 0, *[None] * 14)]
    o = spark.createDataFrame(rows, "t bigint, k bigint, cx double, cy double, cz double, " + ", ".join(f"{r} double" for r in R) + ", xn double, yn double")
    placed = triangulate(o, ["t"])
    got = {r.t: r for r in placed.collect()}
    assert all(np.allclose([got[t].x, got[t].y, got[t].z], p, atol=1e-5) for t, p in want.items())
    assert got[90].x is None and got[91].x is None and 92 not in got
    angle = {r.t: r.angle_deg for r in widest_angles(placed, o, ["t"], "k").collect()}
    for t, p in want.items():
        rays = [(p - np.array(r[2:5])) / np.linalg.norm(p - np.array(r[2:5])) for r in rows if r[0] == t]
        assert abs(angle[t] - max(math.degrees(math.acos(max(-1, min(1, rays[0] @ r)))) for r in rays)) < 1e-4
    assert triangulate(o.limit(0), ["t"]).count() == 0


@pytest.mark.parametrize("angles", [(0, 0, 0), (30, -45, 10), (-170, -90, 5)])
def test_gimbal_rotation(spark, angles):
    row = spark.range(1).select(*[c.alias(r) for c, r in zip(gimbal_rotation(*[F.lit(float(a)) for a in angles]), R)]).first()
    assert np.allclose([row[r] for r in R], turn(*angles).ravel())
