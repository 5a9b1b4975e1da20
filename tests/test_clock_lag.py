"""Lags against a search over whole flights in numpy, and on flights whose lag is known."""

import math
import random

import numpy as np
import pytest

from kestrelgrid.operators.clock_lag import estimate_lags

PAIR, HEADING, RANGE = "key string, a_ms bigint, b_ms bigint, turn double, t_ms int", "key string, t_ms bigint, deg double, turn int", "key string, lo_s double, hi_s double"


def heading_at(t):
    return 70 * math.sin(t / 37) + 55 * math.sin(t / 11) + 20 * math.sin(t / 5)


def flight(key, lag, sign, seconds=1500, seed=1):
    rnd = random.Random(seed)
    times = sorted(rnd.uniform(0, seconds) for _ in range(seconds * 2))
    heading = [(key, round(t * 1000), (heading_at(t) + 180) % 360 - 180, 0) for t in times]
    pairs = []
    for k in range(20, seconds - 25, 4):
        a, b = k + 0.37, k + 2.91
        pairs.append((key, round(a * 1000), round(b * 1000), sign * (heading_at(b + lag) - heading_at(a + lag)) + rnd.gauss(0, 0.3), 0))
    return pairs, heading


@pytest.fixture(scope="module")
def found(spark):
    flights = [flight("a", 3.217, 1), flight("b", -11.84, -1, seed=2)]
    still = [("c", k * 4000, k * 4000 + 2500, 0.1, 0) for k in range(200)], [("c", k * 500, 10.0, 0) for k in range(2000)]
    pairs = [p for f in (*flights, still) for p in f[0]] + [("a", None, 1, 1.0, 0), ("a", 5, 9, float("nan"), 0), ("d", 0, 5, 1.0, 0)]
    heading = [h for f in (*flights, still) for h in f[1]] + [("a", None, 1.0, 0), ("a", 7, float("nan"), 0), ("a", *flights[0][1][5][1:])]
    args = [spark.createDataFrame(*x) for x in ((pairs, PAIR), (heading, HEADING), ([(k, -15.0, 15.0) for k in "abcd"], RANGE))]
    return args, {r.key: r for r in estimate_lags(*args).collect()}, flights


def test_known_lags(found):
    _, got, _ = found
    for key, lag, sign in (("a", 3.217, 1), ("b", -11.84, -1)):
        assert abs(got[key].lag_s - lag) < 0.02 and got[key].sign == sign and got[key].confident and got[key].median_residual < 1, got[key]
    assert not got["c"].confident and "few turns" in got["c"].reason and "d" not in got


def test_against_whole_flights(found):
    _, got, flights = found
    for (pairs, heading), key in zip(flights, "ab"):
        t, h = (np.array(x, float) for x in zip(*sorted({a: b for _, a, b, _ in heading}.items())))
        t, h = t / 1000, np.degrees(np.unwrap(np.radians(h)))
        a, b, turn = (np.array([p[k] for p in pairs], float) for k in (1, 2, 3))
        a, b = a / 1000, b / 1000

        def cost(lag, sign):
            ok = (a + lag >= t[0]) & (b + lag <= t[-1])
            r = (turn - sign * (np.interp(b + lag, t, h) - np.interp(a + lag, t, h)) + 180) % 360 - 180
            return (np.minimum(np.abs(r[ok]), 20) ** 2).mean()

        coarse = [(cost(-15 + k * 0.1, s), k, -s) for k in range(301) for s in (1, -1)]
        _, k, s = min(coarse)
        fine = [cost(-15 + k * 0.1 + j * 0.01, -s) for j in range(-15, 16)]
        j = int(np.argmin(fine))
        lag = -15 + k * 0.1 + (j - 15) * 0.01
        if 0 < j < 30:
            lag += 0.005 * (fine[j - 1] - fine[j + 1]) / (fine[j - 1] - 2 * fine[j] + fine[j + 1])
        far = min(c for c, i, sign in coarse if sign == s and abs(-15 + i * 0.1 - lag) > 2)
        assert abs(got[key].lag_s - lag) < 0.002 and abs(got[key].uniqueness - far / cost(lag, -s)) < 0.01


def test_empty(spark, found):
    pairs, heading, ranges = found[0]
    assert estimate_lags(pairs.limit(0), heading, ranges).count() == 0 and estimate_lags(pairs, heading.limit(0), ranges).count() == 0
