"""Flights whose fixes lie far apart, as after one wrong fix."""

import random
from collections import Counter

import numpy as np
import pytest

from kestrelgrid.operators.coverage import box_depths, cells_by_depth
from kestrelgrid.plans.points import points
from kestrelgrid.plans.surface import coverage_counts
from kestrelgrid.plans.views import voxel_counts

TELEMETRY = "sample_id bigint, flight_id string, t double, geo struct<lat: double, lon: double, alt_msl: double, alt_rel: double, accuracy_h: double, accuracy_v: double>, gimbal_pitch double, gimbal_roll double, gimbal_yaw double, baro_alt double, is_video boolean, received_at timestamp"


def telemetry(spark, folder, fixes):
    """fixes: (flight_id, t, lat, lon)."""
    rows = [(k, f, t, (lat, lon, 100.0, 50.0, 1.0, 1.0), 0.0, 0.0, 0.0, 100.0, True, None) for k, (f, t, lat, lon) in enumerate(fixes)]
    spark.createDataFrame(rows, TELEMETRY).write.parquet(f"{folder}/telemetry.parquet")
    return str(folder)


@pytest.mark.parametrize("most", [1, 300, 2_000_000])
def test_cells_by_depth(most):
    rnd = random.Random(5)
    for n in (1, 3, 40):
        boxes = [(a, a + rnd.randrange(9), b, b + rnd.randrange(30)) for a, b in ((rnd.randrange(-20, 20), rnd.randrange(-20, 20)) for _ in range(n))]
        want = Counter(Counter((i, j) for a, b, c, e in boxes for i in range(a, b + 1) for j in range(c, e + 1)).values())
        corners = np.array([p for a, b, c, e in boxes for p in ((a, c, 1), (b + 1, c, -1), (a, e + 1, -1), (b + 1, e + 1, 1))])
        assert {k: v for k, v in enumerate(cells_by_depth(*corners.T, most)) if v} == want
    assert not cells_by_depth(*np.zeros((3, 0), np.int64)).any()


def test_box_depths(spark):
    far = 10**6
    df = spark.createDataFrame([("a", 0, far, 0, far), ("a", 0, far, 0, far), ("a", 5, 6, 5, 5), ("b", -3, -3, 2, 2)], "flight_id string, lox bigint, hix bigint, loy bigint, hiy bigint")
    assert {(r.flight_id, r.seen): r.n for r in box_depths(df).collect()} == {("a", 2): (far + 1) ** 2 - 2, ("a", 3): 2, ("b", 1): 1}
    assert box_depths(df.limit(0)).count() == 0


def test_coverage_of_a_wide_view(spark, tmp_path):
    d = telemetry(spark, tmp_path, [("a", 1.0, 10.0, 10.0), ("a", 2.0, 50.0, 60.0), ("a", 21.0, 10.01, 10.01), ("b", 1.0, 10.0, 10.0), ("b", 21.0, 10.0, 10.0)])
    p = [(r.view, int(r.x // 10), int(r.y // 10)) for r in points(spark, d).where("flight_id = 'a'").orderBy("t_ms").collect()]
    (_, i0, j0), (_, i1, j1), _ = p
    cells = (abs(i1 - i0) + 1) * (abs(j1 - j0) + 1)
    assert [r[0] for r in p] == [0, 0, 1] and cells > 10**11
    got = {r.flight_id: (r.cells, r.median_seen, r.least_seen, r.seen_once) for r in coverage_counts(spark, d).collect()}
    assert got == {"a": (cells, 1.0, 1, 1.0), "b": (1, 2.0, 2, 0.0)}


def test_voxels_beyond_a_bigint(spark, tmp_path):
    d = telemetry(spark, tmp_path, [("a", 1.0, 45.0, 10.0), ("a", 2.0, 0.0, 100.0), ("a", 3.0, -44.0, -170.0), ("a", 4.0, -45.0, 10.0), ("b", 1.0, 10.0, 10.0)])
    got = {r.flight_id: (r.voxels, r.tile_m) for r in voxel_counts(spark, d).collect()}
    assert got == {"a": (None, 16.0), "b": (9**3, 1000.0)}
