"""Frames asked for, residuals of observations, windows by extent, sizes of voxel grids, and confidence where something was measured."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import flat, in_camera
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.grid import voxel
from kestrelgrid.plans.camera import _CAMERAS, _LANDMARKS, _landmarks
from kestrelgrid.plans.fits import R, _sightings
from kestrelgrid.plans.geometry import _V, _views
from kestrelgrid.plans.points import POINTS, points
from kestrelgrid.plans.sequence import _FRAMES, frame_sequence

BY = ["flight_id"]
FOCAL_PX, MOST_PX, VOXEL, TRUNC, EXTENT_M, WINDOW, TILE_VOXELS = 1600.0, 0.08, 2.0, 6.0, 150.0, 8, 2_000_000


def frames_by_step(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame of each flight in the order of time."""
    return frame_sequence(spark, d).where("i % 5 = 0").select("flight_id", "i", "frame_index", "t_ms")


def frames_requested(spark: SparkSession, d: str) -> DataFrame:
    """Frames asked for by number, in the order they were asked: each flight's every hundredth from the last down, one of them beyond the end, which is left out."""
    n = frame_sequence(spark, d)
    asked = n.groupBy("flight_id").agg(F.max("i").alias("last")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("last") + 100, F.lit(100))))
    asked = asked.select("flight_id", "i", F.floor((F.col("last") + 100 - F.col("i")) / 100).alias("place"))
    return asked.join(n, ["flight_id", "i"]).select("flight_id", "place", "i", "frame_index")


def observation_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Pixels by which each sighting of a landmark misses it."""
    s = _sightings(spark, d).join(_landmarks(spark, d), ["flight_id", "view"])
    x, y, z = flat(in_camera([F.col(r) for r in R], [F.col(f"c{k}") for k in "xyz"], [F.col(f"l{k}") for k in "xyz"]))
    s = s.withColumns({"px": x, "py": y, "depth": z})
    miss = F.sqrt(F.pow(F.col("px") - F.col("xn"), 2) + F.pow(F.col("py") - F.col("yn"), 2)) * FOCAL_PX
    return s.select("flight_id", "view", "sample_id", steady(miss, 3).alias("miss_px"))


def reprojection_filter(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks whose worst sighting misses by at most 0.08 pixels."""
    g = observation_residuals(spark, d).groupBy("flight_id", "view").agg(F.count("*").alias("n"), F.max("miss_px").alias("worst_px"))
    return g.where(F.col("worst_px") <= MOST_PX)


def extent_windows(spark: SparkSession, d: str) -> DataFrame:
    """Of each view how many of the views behind it, itself among them and eight at most, lie within 150 m of it before the first that doesn't; three at least, as far as there are."""
    v = _views(spark, d)
    ahead = v.select("flight_id", F.col("view").alias("start"), *[F.col(k).alias(f"s{k}") for k in "xyz"], F.explode(F.sequence(F.col("view"), F.col("view") + WINDOW - 1)).alias("view"))
    far = F.sqrt(sum((F.pow(F.col(k) - F.col(f"s{k}"), 2) for k in "xyz"), F.lit(0.0)))
    j = ahead.join(v, ["flight_id", "view"]).withColumn("beyond", steady(far, 3) > EXTENT_M)
    g = j.groupBy("flight_id", "start").agg(F.count("*").alias("known"), F.min(F.when(F.col("beyond"), F.col("view"))).alias("first"), F.collect_set("view").alias("views"))
    inside = F.when(F.col("first").isNull(), F.col("known")).otherwise(F.size(F.filter("views", lambda x: x < F.col("first"))))
    return g.select("flight_id", F.col("start").alias("view"), F.greatest(F.least(F.lit(3), F.col("known")), inside).cast("bigint").alias("size"))


def voxel_counts(spark: SparkSession, d: str) -> DataFrame:
    """Voxels of 2 m that a dense grid over each flight's points and 8 m around takes, and the side of a tile of 2 million. A number of voxels beyond a bigint is NULL."""
    g = points(spark, d).groupBy("flight_id").agg(*[(F.max(a) - F.min(a)).alias(a) for a in "xyz"])
    margin = TRUNC + VOXEL
    dims = [F.greatest(F.lit(1), F.ceil(steady((F.col(a) + 2 * margin) / VOXEL, 6)).cast("bigint")) + 1 for a in "xyz"]
    high = F.greatest((F.col("z") + 2 * margin) / VOXEL, F.lit(1.0))
    tile = F.greatest(F.sqrt(F.greatest(TILE_VOXELS / high, F.lit(1.0))) * VOXEL, F.lit(VOXEL * 8))
    return g.select("flight_id", reduce(F.try_multiply, dims).alias("voxels"), steady(tile, 3).alias("tile_m"))


def voxel_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The lowest tier in the voxel of 10 m that each view's mean place falls in, and whether a measurement there deserves a warning; no voxel, no tier."""
    k = {f"i{a}": voxel(a, 10.0) for a in "xyz"}
    held = points(spark, d).withColumns(k).groupBy("flight_id", *k).agg(F.min("tier").alias("tier"))
    v = _views(spark, d).withColumns(k).join(held, ["flight_id", *k], "left")
    return v.select("flight_id", "view", "tier", F.coalesce(F.col("tier") == 0, F.lit(True)).alias("warn"))


def keyframe_altitudes(spark: SparkSession, d: str) -> DataFrame:
    """Height above take-off at the first fix of each view, where it is above 0."""
    g = points(spark, d).groupBy("flight_id", "view").agg(F.min_by(F.struct("alt_rel", "sample_id"), "t_ms").alias("a"))
    return g.where("a.alt_rel > 0").select("flight_id", "view", "a.sample_id", "a.alt_rel")


_SEEN = f"""{_CAMERAS}, {_LANDMARKS}, off AS (SELECT c.*, lx - x AS ox, ly - y AS oy, lz - z AS oz FROM camera c JOIN landmark USING (flight_id, view)),
seen AS (SELECT flight_id, view, sample_id, r00 * ox + r10 * oy + r20 * oz AS sx, r01 * ox + r11 * oy + r21 * oz AS sy, r02 * ox + r12 * oy + r22 * oz AS sz FROM off),
miss AS (SELECT flight_id, view, sample_id, {steady_sql(f"sqrt((sx / sz - {steady_sql('sx / sz', 4)}) ** 2 + (sy / sz - {steady_sql('sy / sz', 4)}) ** 2) * {FOCAL_PX}", 3)} AS miss_px FROM seen WHERE sz > 1 AND abs(sx) <= 2 * sz AND abs(sy) <= 2 * sz)"""
SQL = {
    "frames_by_step": f"WITH {_FRAMES} SELECT flight_id, i, frame_index, t_ms FROM numbered WHERE i % 5 = 0",
    "frames_requested": f"WITH {_FRAMES}, l AS (SELECT flight_id, max(i) AS last FROM numbered GROUP BY ALL) SELECT n.flight_id, CAST((last + 100 - i) // 100 AS BIGINT) AS place, i, frame_index FROM numbered n JOIN l ON l.flight_id = n.flight_id WHERE i % 100 = 0",
    "observation_residuals": f"WITH {_SEEN} SELECT * FROM miss",
    "reprojection_filter": f"WITH {_SEEN} SELECT flight_id, view, count(*) AS n, max(miss_px) AS worst_px FROM miss GROUP BY flight_id, view HAVING max(miss_px) <= {MOST_PX}",
    "extent_windows": f"""WITH {_V}, j AS (SELECT a.flight_id, a.view AS start, b.view, {steady_sql('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)', 3)} > {EXTENT_M} AS beyond FROM v a JOIN v b ON b.flight_id = a.flight_id AND b.view BETWEEN a.view AND a.view + {WINDOW - 1}),
f AS (SELECT flight_id, start, count(*) AS known, min(view) FILTER (beyond) AS first FROM j GROUP BY ALL) SELECT f.flight_id, f.start AS view, greatest(least(3, any_value(known)), count(*) FILTER (first IS NULL OR view < first)) AS size FROM f JOIN j ON j.flight_id = f.flight_id AND j.start = f.start GROUP BY f.flight_id, f.start""",
    "voxel_counts": f"""WITH {POINTS}, g AS (SELECT flight_id, {', '.join(f'max({a}) - min({a}) AS {a}' for a in 'xyz')} FROM point GROUP BY flight_id)
SELECT flight_id, {' * '.join(f"(greatest(1, CAST(ceil({steady_sql(f'({a} + {2 * (TRUNC + VOXEL)}) / {VOXEL}', 6)}) AS BIGINT)) + 1)" for a in 'xyz')} AS voxels, {steady_sql(f'greatest(sqrt(greatest({TILE_VOXELS} / greatest((z + {2 * (TRUNC + VOXEL)}) / {VOXEL}, 1.0), 1.0)) * {VOXEL}, {VOXEL * 8})', 3)} AS tile_m FROM g""",
    "voxel_confidence": f"""WITH {_V}, h AS (SELECT flight_id, {', '.join(f'floor({a} / 10.0) AS i{a}' for a in 'xyz')}, min(tier) AS tier FROM point GROUP BY ALL) SELECT v.flight_id, view, tier, coalesce(tier = 0, true) AS warn FROM v LEFT JOIN h ON h.flight_id = v.flight_id AND {' AND '.join(f'h.i{a} = floor(v.{a} / 10.0)' for a in 'xyz')}""",
    "keyframe_altitudes": f"WITH {POINTS}, f AS (SELECT * FROM point QUALIFY row_number() OVER (PARTITION BY flight_id, view ORDER BY t_ms) = 1) SELECT flight_id, view, sample_id, alt_rel FROM f WHERE alt_rel > 0",
}
QUERIES = {name: globals()[name] for name in SQL}
