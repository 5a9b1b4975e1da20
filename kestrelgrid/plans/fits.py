"""Fits over the flights: similarities, clock lags, tracks through places, and places from what cameras see of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import flat, in_camera
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.clock_lag import estimate_lags
from kestrelgrid.operators.grid import voxel
from kestrelgrid.operators.split_windows import numbered
from kestrelgrid.operators.similarity import R, robust_similarity, similarity_fits
from kestrelgrid.operators.tracks import build_tracks
from kestrelgrid.operators.triangulation import triangulate, widest_angles
from kestrelgrid.plans.camera import _CAMERAS, _LANDMARKS, _landmarks, cameras
from kestrelgrid.plans.points import points, series
from kestrelgrid.plans.sequence import moves
from kestrelgrid.sources.tables import table

BY = ["flight_id"]
#: The plain frame of a flight: metres by degrees, without the curve of the earth.
METRES = 111_320.0


def _plain_places(spark: SparkSession, d: str) -> DataFrame:
    """Fixes in their exact local frame (u, v, w) and in thousandths of degrees about the flight's first fix (x, y, z)."""
    p = points(spark, d)
    s = series(spark, d).select("flight_id", "t_ms", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))
    first = points(spark, d).groupBy("flight_id").agg(F.min("t_ms").alias("t_ms")).join(s, ["flight_id", "t_ms"]).select("flight_id", F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    j = p.join(s, ["flight_id", "t_ms"]).join(first, BY)
    return j.select("flight_id", "sample_id", ((F.col("lon") - F.col("lon0")) * F.cos(F.radians("lat0")) * 1000).alias("x"), ((F.col("lat") - F.col("lat0")) * 1000).alias("y"), (F.col("z") / METRES * 1000).alias("z"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w"))


def degree_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Scale that takes thousandths of degrees to metres in each flight's frame, by a fit in space, and what it leaves."""
    f = similarity_fits(_plain_places(spark, d), BY)
    return f.select("flight_id", "n", steady(F.when(~F.col("degenerate"), F.col("scale")), 1).alias("scale"), steady(F.col("rmse"), 1).alias("rmse"), "degenerate")


def robust_degree_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The same by the fixes that the best of 64 hypotheses explains to 5 m."""
    f = robust_similarity(_plain_places(spark, d), BY, "sample_id", within=5.0)
    return f.select("flight_id", "inliers", "total", steady(F.col("scale"), 2).alias("scale"), steady(F.col("rmse"), 3).alias("rmse"))


def clock_lags(spark: SparkSession, d: str) -> DataFrame:
    """Lag of each flight's gimbal behind its course, over the range its latest estimate states, else 15 s to either side.

    Turns are those of the course between one move and the first at least two seconds later, six at most.
    """
    m = moves(spark, d).select(F.col("flight_id").alias("key"), "t_ms", "course", F.floor(F.col("t_ms") / 4000).cast("bigint").alias("span"))
    one = m.groupBy("key", "span").agg(F.min(F.struct("t_ms", "course")).alias("a"))
    after = one.select("key", (F.col("span") - 1).alias("span"), F.col("a").alias("b"))
    pairs = one.join(after, ["key", "span"]).select("key", F.col("a.t_ms").alias("a_ms"), F.col("b.t_ms").alias("b_ms"), (F.col("b.course") - F.col("a.course")).alias("turn")).where("b_ms - a_ms BETWEEN 2000 AND 6000")
    heading = series(spark, d).where("gimbal_yaw IS NOT NULL").select(F.col("flight_id").alias("key"), "t_ms", F.col("gimbal_yaw").alias("deg"))
    said = table(spark, d, "sync_estimates").where("search_lo_s <= search_hi_s").groupBy("flight_id").agg(F.max(F.struct("estimated_at", "sync_id", "search_lo_s", "search_hi_s")).alias("s"))
    ranges = table(spark, d, "flights").select("flight_id").distinct().join(said, BY, "left").select(F.col("flight_id").alias("key"), F.coalesce("s.search_lo_s", F.lit(-15.0)).alias("lo_s"), F.coalesce("s.search_hi_s", F.lit(15.0)).alias("hi_s"))
    return estimate_lags(pairs, heading, ranges).withColumnRenamed("key", "flight_id")


def place_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks of 3 m squares through the views of a flight: a square is matched with itself and its eastern neighbour in the next view, the same first; their lengths."""
    v = points(spark, d).select("flight_id", F.col("view"), voxel("x", 3.0).alias("i"), voxel("y", 3.0).alias("j")).distinct()
    flights = table(spark, d, "flights").select("flight_id").distinct()
    # a place's key is its number among the places of its flight, the flights one behind the other; views beyond a day's are no frames
    places = v.where("view BETWEEN 0 AND 4319").select("flight_id", "i", "j").distinct().join(flights, BY)
    numbers = numbered(places.withColumn("all", F.lit(0)).withColumn("bucket", F.pmod(F.xxhash64("flight_id", "i", "j"), F.lit(1 << 16))), ["all"], ["flight_id", "i", "j"], "bucket", "ka").select("flight_id", "i", "j", "ka")
    here = v.where("view BETWEEN 0 AND 4319").join(numbers, ["flight_id", "i", "j"])
    step = F.explode(F.array(F.lit(0), F.lit(1)))
    asked = here.withColumn("step", step).select("flight_id", (F.col("view") + 1).alias("view"), (F.col("i") + F.col("step")).alias("i"), "j", "ka", "step")
    found = asked.join(here.select("flight_id", "view", "i", "j", F.col("ka").alias("kb")), ["flight_id", "view", "i", "j"])
    tracks = build_tracks(found.select((F.col("view") - 1).cast("int").alias("fa"), "ka", F.col("view").cast("int").alias("fb"), "kb", (F.col("step") * 1_000_000 + F.col("view")).cast("bigint").alias("place")))
    return tracks.groupBy("track").agg(F.count("*").alias("n"), F.min("frame").alias("first_view"), F.max("frame").alias("last_view"))


def _sightings(spark: SparkSession, d: str) -> DataFrame:
    """Each view's landmark as its cameras see it, in flat directions to a ten-thousandth."""
    c = cameras(spark, d).join(_landmarks(spark, d), ["flight_id", "view"])
    seen = in_camera([F.col(r) for r in R], [F.col(k) for k in "xyz"], [F.col(f"l{k}") for k in "xyz"])
    c = c.withColumns(dict(zip(("sx", "sy", "sz"), seen)))
    x, y, _ = flat([F.col(f"s{k}") for k in "xyz"])
    c = c.where("sz > 1 AND abs(sx) <= 2 * sz AND abs(sy) <= 2 * sz")
    return c.select("flight_id", "view", "sample_id", *[F.col(k).alias(f"c{k}") for k in "xyz"], *R, steady(x, 4).alias("xn"), steady(y, 4).alias("yn"))


def landmark_triangulation(spark: SparkSession, d: str) -> DataFrame:
    """Landmarks placed again from what their cameras see: how many saw each, how far off the place is, and the widest angle from the first camera."""
    s, by = _sightings(spark, d), ["flight_id", "view"]
    placed = triangulate(s, by)
    wide = widest_angles(placed, s, by, "sample_id")
    off = F.sqrt(sum((F.pow(F.col(k) - F.col(f"l{k}"), 2) for k in "xyz"), F.lit(0.0)))
    j = placed.join(_landmarks(spark, d), by).join(wide, by, "left")
    # a place without depth to it says nothing
    sure = F.coalesce(F.col("angle_deg") >= 5, F.lit(False))
    return j.select("flight_id", "view", "n", steady(F.when(sure, off), 1).alias("off_m"), steady(F.when(sure, F.col("angle_deg")), 1).alias("angle_deg"))


_AXES = {k: (f"r{i}0", f"r{i}1", f"r{i}2") for i, k in enumerate("xyz")}
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"), ("x", "c"), ("y", "c"), ("z", "c")]
# no SQL for the others: singular values, searches over lags and chaining in order are tested against numpy and brute force
SQL = {
    "landmark_triangulation": f"""WITH {_CAMERAS}, {_LANDMARKS}, off AS (SELECT c.*, lx - x AS ox, ly - y AS oy, lz - z AS oz, lx, ly, lz FROM camera c JOIN landmark USING (flight_id, view)),
seen AS (SELECT *, r00 * ox + r10 * oy + r20 * oz AS sx, r01 * ox + r11 * oy + r21 * oz AS sy, r02 * ox + r12 * oy + r22 * oz AS sz FROM off),
s AS (SELECT *, {steady_sql('sx / sz', 4)} AS xn, {steady_sql('sy / sz', 4)} AS yn FROM seen WHERE sz > 1 AND abs(sx) <= 2 * sz AND abs(sy) <= 2 * sz),
e AS (SELECT *, {', '.join(f'first_value({k}) OVER w AS o{k}_, xn * {c} - {a} AS a{k}, yn * {c} - {b} AS h{k}' for k, (a, b, c) in _AXES.items())} FROM s WINDOW w AS (PARTITION BY flight_id, view ORDER BY x, y, z)),
q AS (SELECT *, {', '.join(' + '.join(f'{n}{k} * ({k} - o{k}_)' for k in 'xyz') + f' AS {n}c' for n in 'ah')} FROM e),
t AS (SELECT flight_id, view, count(*) AS n, any_value(ox_) AS ox, any_value(oy_) AS oy, any_value(oz_) AS oz, any_value(lx) AS lx, any_value(ly) AS ly, any_value(lz) AS lz, {', '.join(f'sum(a{i} * a{j} + h{i} * h{j}) AS {i}{j}' for i, j in _PAIRS)} FROM q GROUP BY ALL),
m AS (SELECT *, yy * zz - yz * yz AS ax, xz * yz - xy * zz AS ay, xy * yz - xz * yy AS az, xx * zz - xz * xz AS b_y, xy * xz - xx * yz AS bz, xx * yy - xy * xy AS cz FROM t), d AS (SELECT *, xx * ax + xy * ay + xz * az AS det FROM m),
p AS (SELECT flight_id, view, n, lx, ly, lz, CASE WHEN n >= 2 AND det > 1e-12 * (xx + yy + zz) ** 3 THEN ox + (ax * xc + ay * yc + az * zc) / det END AS px, oy + (ay * xc + b_y * yc + bz * zc) / det AS py, oz + (az * xc + bz * yc + cz * zc) / det AS pz FROM d),
u AS (SELECT s.flight_id, s.view, sample_id, (px - x) / l AS dx, (py - y) / l AS dy, (pz - z) / l AS dz FROM (SELECT s.*, px, py, pz, sqrt((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2) AS l FROM s JOIN p ON p.flight_id = s.flight_id AND p.view = s.view WHERE px IS NOT NULL) s WHERE l > 1e-9),
f AS (SELECT *, first_value(dx) OVER w AS fx, first_value(dy) OVER w AS fy, first_value(dz) OVER w AS fz FROM u WINDOW w AS (PARTITION BY flight_id, view ORDER BY sample_id)), g AS (SELECT flight_id, view, degrees(acos(greatest(-1.0, least(1.0, min(dx * fx + dy * fy + dz * fz))))) AS deg FROM f GROUP BY ALL)
SELECT p.flight_id, p.view, n, CASE WHEN deg >= 5 THEN {steady_sql('sqrt((px - lx) ** 2 + (py - ly) ** 2 + (pz - lz) ** 2)', 1)} END AS off_m, CASE WHEN deg >= 5 THEN {steady_sql('deg', 1)} END AS angle_deg FROM p LEFT JOIN g ON g.flight_id = p.flight_id AND g.view = p.view""",
}
QUERIES = {name: globals()[name] for name in ("degree_similarity", "robust_degree_similarity", "clock_lags", "place_tracks", "landmark_triangulation")}
