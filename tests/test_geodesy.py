"""Map coordinates against the Gauss-Krueger integrals worked out by numbers."""

import numpy as np
from pyspark.sql import functions as F

from kestrelgrid.functions.geodesy import A, E2, utm_forward


def test_utm(spark):
    rows = [(48.0, 9.0, 32), (48.0, 11.9, 32), (-33.5, 151.2, 56), (0.0, 3.0, 31), (60.0, 5.0, 32)]
    df = spark.createDataFrame(rows, "lat double, lon double, zone int")
    e, n = utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    got = {(r.lat, r.lon): (r.e, r.n) for r in df.select("lat", "lon", e.alias("e"), n.alias("n")).collect()}
    # on the middle meridian the northing is the arc of the meridian
    phi = np.linspace(0, np.radians(48), 200_001)
    f = A * (1 - E2) / (1 - E2 * np.sin(phi) ** 2) ** 1.5
    arc = float(np.sum((f[1:] + f[:-1]) / 2) * (phi[1] - phi[0]))
    assert abs(got[48.0, 9.0][0] - 500_000) < 1e-3 and abs(got[48.0, 9.0][1] - 0.9996 * arc) < 2e-3
    assert abs(got[0.0, 3.0][1]) < 1e-6 and abs(got[0.0, 3.0][0] - 500_000) < 1e-3
    # conformal: a small step east and one north are scaled alike and at right angles
    step = 1e-6
    near = spark.createDataFrame([(60.0, 5.0, 32), (60.0 + step, 5.0, 32), (60.0, 5.0 + step, 32)], "lat double, lon double, zone int")
    o, north, east = (np.array(r) for r in near.select(e, n).collect())
    s = np.sin(np.radians(60))
    m = A * (1 - E2) / (1 - E2 * s * s) ** 1.5 * np.radians(step)
    p = A / np.sqrt(1 - E2 * s * s) * np.cos(np.radians(60)) * np.radians(step)
    a, b = (north - o) / m, (east - o) / p
    assert abs(np.linalg.norm(a) - np.linalg.norm(b)) < 1e-5 and abs(a @ b) < 1e-5 and 0.999 < np.linalg.norm(a) < 1.001
    assert 6_200_000 < got[-33.5, 151.2][1] < 6_300_000
