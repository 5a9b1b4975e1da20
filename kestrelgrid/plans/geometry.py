"""Camera geometry, neighbourhood filters, transforms and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.grid import counted_median, voxel
from kestrelgrid.operators.split_windows import neighbours
from kestrelgrid.plans.points import POINTS, points
from kestrelgrid.plans.surface import _DSM, BY, CELL, grid_dsm
from kestrelgrid.sources.tables import table

#: Half fields of view of the camera whose footprints are drawn, as tangents, and its focal length in pixels.
TAN_H, TAN_V, FOCAL_PX = 0.75, 0.42, 1600.0


def frame_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Corners of what the camera sees of the ground from each fix; NULL where a corner looks level or up, the camera is lower than 1 m, or a corner lies beyond 2 km."""
    p = points(spark, d).where("pitch IS NOT NULL AND yaw IS NOT NULL AND alt_rel IS NOT NULL")
    tilt, head = F.radians("pitch"), F.radians("yaw")
    out = []
    for k, (u, v) in enumerate(((-1, 1), (1, 1), (1, -1), (-1, -1))):
        f, r, z = F.cos(tilt) - v * TAN_V * F.sin(tilt), F.lit(u * TAN_H), F.sin(tilt) + v * TAN_V * F.cos(tilt)
        s = F.when(z < -1e-6, -F.col("alt_rel") / z)
        e, n = s * (f * F.sin(head) + r * F.cos(head)), s * (f * F.cos(head) - r * F.sin(head))
        far = F.sqrt(e * e + n * n)
        out.append(F.when((F.col("alt_rel") > 1) & (far <= 2000), F.struct((F.col("x") + e).alias("e"), (F.col("y") + n).alias("n"))).alias(f"c{k}"))
    c = p.select("flight_id", "sample_id", *out)
    whole = F.col("c0").isNotNull() & F.col("c1").isNotNull() & F.col("c2").isNotNull() & F.col("c3").isNotNull()
    ring = [F.col(f"c{k}") for k in (0, 1, 2, 3, 0)]
    area = F.abs(sum((a["e"] * b["n"] - b["e"] * a["n"] for a, b in zip(ring, ring[1:])), F.lit(0.0))) / 2
    return c.select("flight_id", "sample_id", steady(F.when(whole, area), 2).alias("area_m2"), steady(F.when(whole, F.col("c0.e")), 3).alias("e0"), steady(F.when(whole, F.col("c0.n")), 3).alias("n0"))


def median_gsd(spark: SparkSession, d: str) -> DataFrame:
    """Ground covered by a pixel at the median height above take-off, in mm."""
    m = counted_median(points(spark, d).where("alt_rel > 0").withColumn("mm", F.round(F.col("alt_rel") * 1000).cast("bigint")), BY, "mm")
    return m.select("flight_id", steady(F.col("m") / FOCAL_PX, 5).alias("gsd_mm"))


def keyframe_velocity(spark: SparkSession, d: str) -> DataFrame:
    """Velocity by central differences, one-sided at the ends; rows where time doesn't advance are left out."""
    p = neighbours(points(spark, d), BY, ["t_ms"], "bucket", ["x", "y", "z"])
    a, b = ({c: F.coalesce(f"{side}.{c}", c) for c in ("t_ms", "x", "y", "z")} for side in ("prev", "next"))
    dt = (b["t_ms"] - a["t_ms"]) / 1000
    return p.where(dt > 0).select("flight_id", "t_ms", *[steady((b[c] - a[c]) / dt, 4).alias(f"v{c}") for c in "xyz"])


def uncertainty_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Worst accuracy in each square of 25 m."""
    v = {f"i{a}": voxel(a, 25.0) for a in "xy"}
    return points(spark, d).where("acc IS NOT NULL").withColumns(v).groupBy("flight_id", *v).agg(F.max("acc").alias("worst"), F.count("*").alias("n"))


def _views(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("flight_id", "view").agg(*[steady(F.avg(a), 3).alias(a) for a in "xyz"])


def gps_radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of views that follow each other within three, and all others within 40 m.

    Squares of 40 m are joined with the squares around, so a view meets only views near it.
    """
    v = _views(spark, d).withColumns({f"i{a}": voxel(a, 40.0) for a in "xy"})
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = v.select("flight_id", F.col("view").alias("b"), *[F.col(k).alias(f"b{k}") for k in "xyz"], "ix", "iy")
    a = b.withColumn("o", o).withColumns({"ix": F.col("ix") + F.col("o.i"), "iy": F.col("iy") + F.col("o.j")}).drop("o")
    dist = steady(F.sqrt(sum((F.pow(F.col(k) - F.col(f"b{k}"), 2) for k in "xyz"), F.lit(0.0))), 3)
    near = a.join(v, ["flight_id", "ix", "iy"]).where(F.col("view") < F.col("b") - 3).withColumn("dist", dist).where("dist <= 40")
    back = b.drop("ix", "iy").withColumn("view", F.explode(F.array(*[F.col("b") - k for k in (1, 2, 3)])))
    follow = back.join(v, ["flight_id", "view"]).withColumn("dist", dist)
    columns = ["flight_id", F.col("view").alias("a"), "b", "dist"]
    return near.select(*columns, F.lit("near").alias("why")).unionByName(follow.select(*columns, F.lit("next").alias("why")))


def trajectory_class(spark: SparkSession, d: str) -> DataFrame:
    """Shape of each flight: vertical, linear, orbit or curved, in this order."""
    v = _views(spark, d)
    m = v.groupBy("flight_id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"), (F.max("z") - F.min("z")).alias("dz"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("dh"))
    r = v.join(m.select("flight_id", "mx", "my"), BY).withColumn("r", F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2)))
    cv = r.groupBy("flight_id").agg((F.stddev_pop("r") / F.nullif(F.avg("r"), F.lit(0.0))).alias("cv"))
    root = F.sqrt(F.pow(F.col("sxx") - F.col("syy"), 2) + 4 * F.col("sxy") * F.col("sxy"))
    lin = steady(F.when(F.col("sxx") + F.col("syy") > 0, root / (F.col("sxx") + F.col("syy"))), 4)
    kind = F.when(F.col("n") < 3, "short").when(F.col("dz") > 2 * F.col("dh"), "vertical").when(lin >= 0.85, "linear").when(steady(F.col("cv"), 4) < 0.35, "orbit").otherwise("curved")
    return m.join(cv, BY).select("flight_id", "n", lin.alias("collinear"), kind.alias("kind"))


def morphological_ground(spark: SparkSession, d: str) -> DataFrame:
    """Cells whose lowest point stands at most 0.8 m above the opening of the surface with a window of 3 cells."""
    low = points_grid_min(spark, d)
    opened = _dilate(_erode(low))
    return low.join(opened.withColumnRenamed("z", "opened"), CELL).withColumn("ground", F.round(F.col("z") - F.col("opened"), 3) <= 0.8).select(*CELL, "z", "opened", "ground")


def points_grid_min(spark: SparkSession, d: str) -> DataFrame:
    from kestrelgrid.operators.grid import raster_cells
    from kestrelgrid.plans.surface import RES

    return raster_cells(points(spark, d), BY, RES).groupBy(*CELL).agg(F.min("z").alias("z"))


def _spread(cells: DataFrame, best: Column) -> DataFrame:
    """Each cell's value offered to the 3 x 3 cells around; known cells keep the best offer."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    offered = cells.withColumn("o", o).select("flight_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "z", ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return offered.groupBy(*CELL).agg(best.alias("z"), F.max("own").alias("own")).where("own").drop("own")


def _erode(cells: DataFrame) -> DataFrame:
    return _spread(cells, F.min("z"))


def _dilate(cells: DataFrame) -> DataFrame:
    return _spread(cells, F.max("z"))


def similarity_fit(spark: SparkSession, d: str) -> DataFrame:
    """Scale and rotation that take local metres to degrees of longitude (shortened by latitude) and latitude, closed form in the plane."""
    s = points(spark, d).select("flight_id", "sample_id", "x", "y")
    geo = table(spark, d, "telemetry").select("sample_id", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon")).distinct()
    j = s.join(geo, "sample_id")
    m = j.groupBy("flight_id").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("x", "y", "lat", "lon")])
    c = j.join(m, BY).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my"), "p": (F.col("lon") - F.col("mlon")) * F.cos(F.radians("mlat")), "q": F.col("lat") - F.col("mlat")})
    g = c.groupBy("flight_id").agg(F.first("n").alias("n"), F.sum(F.col("u") * F.col("p") + F.col("v") * F.col("q")).alias("re"), F.sum(F.col("u") * F.col("q") - F.col("v") * F.col("p")).alias("im"), F.sum(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("ss"))
    ok = (F.col("n") >= 3) & (F.col("ss") > 1.0)
    return g.select("flight_id", "n", steady(F.when(ok, F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("ss") * 111000), 3).alias("scale"), steady(F.when(ok, F.degrees(F.atan2("im", "re"))), 2).alias("turn_deg"))


def merge_transformed(spark: SparkSession, d: str) -> DataFrame:
    """Recording and other points, the latter raised by 2 cm, merged and collapsed on places of 10 cm, lowest confidence kept."""
    p = points(spark, d)
    parts = p.where("label = 1").select("flight_id", "x", "y", "z", "tier", F.lit(1).alias("part")).unionByName(p.where("label <> 1").select("flight_id", "x", "y", F.round(F.col("z") + 0.02, 3).alias("z"), "tier", F.lit(2).alias("part")))
    q = {f"q{a}": F.rint(F.col(a) / 0.1).cast("bigint") for a in "xyz"}
    return parts.withColumns(q).groupBy("flight_id", *q).agg(steady(F.avg("z"), 4).alias("z"), F.min("tier").alias("tier"), F.min("part").alias("part"), F.count("*").alias("n"))


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of the fixes, the same for the same seed: those whose id hashes low (multiplicative hash, seed 42)."""
    h = F.pmod((F.col("sample_id") + 42) * 2654435761, F.lit(4294967296))
    return points(spark, d).where(h < 429496730).select("flight_id", "sample_id")


def views_covering(spark: SparkSession, d: str) -> DataFrame:
    """Of each 50 m square the three views with most fixes in it, the earlier of equals."""
    v = {f"i{a}": voxel(a, 50.0) for a in "xy"}
    n = points(spark, d).withColumns(v).groupBy("flight_id", *v, "view").agg(F.count("*").alias("n"))
    w = Window.partitionBy("flight_id", *v).orderBy(F.desc("n"), "view")
    return n.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 3")


def edge_length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Edges between neighbouring surface cells of a row, without those over six times the flight's median length."""
    c = grid_dsm(spark, d).select("flight_id", "row", "col", "z")
    e = c.alias("a").join(c.select("flight_id", "row", (F.col("col") - 1).alias("col"), F.col("z").alias("zb")), CELL)
    e = e.withColumn("mm", F.round(F.sqrt(25 + F.pow(F.col("zb") - F.col("z"), 2)) * 1000).cast("bigint"))
    return e.join(counted_median(e, BY, "mm"), BY).where(F.col("mm") <= 6 * F.col("m")).select(*CELL, "mm")


def fix_classes(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of fix stated in the exported logs: codes 6 and 50 are RTK fixed, 5 and 34 float, words by what they hold."""
    from kestrelgrid.plans.p3_drift import p3_telemetry

    low, code = F.lower(F.trim("fix")), F.col("fix").try_cast("double").try_cast("int")
    kind = F.when(code.isin(6, 50), "rtk_fixed").when(code.isin(5, 34), "rtk_float").when(code.isNotNull(), "standard").when(low.contains("fixed"), "rtk_fixed").when(low.contains("float"), "rtk_float").otherwise("standard")
    return p3_telemetry(spark, d).where("fix IS NOT NULL").groupBy("file_id", kind.alias("kind")).agg(F.count("*").alias("n"))


_V = f"""{POINTS}, v AS (SELECT flight_id, view, {', '.join(f"{steady_sql(f'avg({a})', 3)} AS {a}" for a in 'xyz')} FROM point GROUP BY ALL)"""


def _corner(k: int, u: int, v: int) -> str:
    z = f"(sin(radians(pitch)) + {v * TAN_V} * cos(radians(pitch)))"
    f = f"(cos(radians(pitch)) - {v * TAN_V} * sin(radians(pitch)))"
    e = f"({f} * sin(radians(yaw)) + {u * TAN_H} * cos(radians(yaw)))"
    n = f"({f} * cos(radians(yaw)) - {u * TAN_H} * sin(radians(yaw)))"
    return f"CASE WHEN {z} < -1e-6 THEN -alt_rel / {z} * {e} END AS e{k}, CASE WHEN {z} < -1e-6 THEN -alt_rel / {z} * {n} END AS n{k}"


_OK = "alt_rel > 1 AND " + " AND ".join(f"sqrt(e{k} * e{k} + n{k} * n{k}) <= 2000" for k in range(4))
_AREA = "abs(" + " + ".join(f"((x + e{a}) * (y + n{b}) - (x + e{b}) * (y + n{a}))" for a, b in ((0, 1), (1, 2), (2, 3), (3, 0))) + ") / 2"
_AROUND = "(SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j))"


def _filter(name: str, source: str, best: str) -> str:
    return f"{name} AS (SELECT a.flight_id, a.row, a.col, {best}(b.z) AS z FROM {source} a JOIN {source} b ON b.flight_id = a.flight_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL)"


SQL = {
    "frame_footprints": f"""WITH {POINTS}, c AS (SELECT *, {', '.join(_corner(k, u, v) for k, (u, v) in enumerate(((-1, 1), (1, 1), (1, -1), (-1, -1))))} FROM point WHERE pitch IS NOT NULL AND yaw IS NOT NULL AND alt_rel IS NOT NULL)
SELECT flight_id, sample_id, {steady_sql(f'CASE WHEN {_OK} THEN {_AREA} END', 2)} AS area_m2, {steady_sql(f'CASE WHEN {_OK} THEN x + e0 END', 3)} AS e0, {steady_sql(f'CASE WHEN {_OK} THEN y + n0 END', 3)} AS n0 FROM c""",
    "median_gsd": f"WITH {POINTS} SELECT flight_id, {steady_sql(f'quantile_cont(round(alt_rel * 1000), 0.5) / {FOCAL_PX}', 5)} AS gsd_mm FROM point WHERE alt_rel > 0 GROUP BY flight_id",
    "keyframe_velocity": f"""WITH {POINTS}, n AS (SELECT flight_id, t_ms, {', '.join(f'coalesce(lag({c}) OVER w, {c}) AS {c}1, coalesce(lead({c}) OVER w, {c}) AS {c}2' for c in ('t_ms', 'x', 'y', 'z'))} FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms))
SELECT flight_id, t_ms, {', '.join(f"{steady_sql(f'({c}2 - {c}1) / ((t_ms2 - t_ms1) / 1000)', 4)} AS v{c}" for c in 'xyz')} FROM n WHERE t_ms2 > t_ms1""",
    "uncertainty_heatmap": f"WITH {POINTS} SELECT flight_id, CAST(floor(x / 25.0) AS BIGINT) AS ix, CAST(floor(y / 25.0) AS BIGINT) AS iy, max(acc) AS worst, count(*) AS n FROM point WHERE acc IS NOT NULL GROUP BY flight_id, floor(x / 25.0), floor(y / 25.0)",
    "gps_radius_pairs": f"""WITH {_V}, p AS (SELECT b.flight_id, a.view AS a, b.view AS b, {steady_sql('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)', 3)} AS dist FROM v a JOIN v b ON b.flight_id = a.flight_id AND a.view < b.view)
SELECT flight_id, a, b, dist, CASE WHEN b - a <= 3 THEN 'next' ELSE 'near' END AS why FROM p WHERE b - a <= 3 OR dist <= 40""",
    "trajectory_class": f"""WITH {_V}, m AS (SELECT flight_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy, max(z) - min(z) AS dz, greatest(max(x) - min(x), max(y) - min(y)) AS dh FROM v GROUP BY ALL),
r AS (SELECT flight_id, stddev_pop(sqrt((x - mx) ** 2 + (y - my) ** 2)) / nullif(avg(sqrt((x - mx) ** 2 + (y - my) ** 2)), 0.0) AS cv FROM v JOIN m USING (flight_id) GROUP BY ALL),
k AS (SELECT *, {steady_sql('CASE WHEN sxx + syy > 0 THEN sqrt((sxx - syy) ** 2 + 4 * sxy * sxy) / (sxx + syy) END', 4)} AS collinear FROM m JOIN r USING (flight_id))
SELECT flight_id, n, collinear, CASE WHEN n < 3 THEN 'short' WHEN dz > 2 * dh THEN 'vertical' WHEN collinear >= 0.85 THEN 'linear' WHEN {steady_sql('cv', 4)} < 0.35 THEN 'orbit' ELSE 'curved' END AS kind FROM k""",
    "morphological_ground": f"""WITH {_DSM}, low AS (SELECT flight_id, row, col, min(z) AS z FROM grid GROUP BY ALL), {_filter('er', 'low', 'min')}, {_filter('di', 'er', 'max')} SELECT flight_id, row, col, low.z AS z, di.z AS opened, round(low.z - di.z, 3) <= 0.8 AS ground FROM low JOIN di USING (flight_id, row, col)""",
    "similarity_fit": f"""WITH {POINTS}, j AS (SELECT p.flight_id, x, y, lat, lon FROM point p JOIN (SELECT DISTINCT sample_id, geo.lat AS lat, geo.lon AS lon FROM telemetry) USING (sample_id)), m AS (SELECT flight_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(lat) AS mlat, avg(lon) AS mlon FROM j GROUP BY ALL),
c AS (SELECT flight_id, n, x - mx AS u, y - my AS v, (lon - mlon) * cos(radians(mlat)) AS p, lat - mlat AS q FROM j JOIN m USING (flight_id)), g AS (SELECT flight_id, any_value(n) AS n, sum(u * p + v * q) AS re, sum(u * q - v * p) AS im, sum(u * u + v * v) AS ss FROM c GROUP BY ALL)
SELECT flight_id, n, {steady_sql('CASE WHEN n >= 3 AND ss > 1.0 THEN sqrt(re * re + im * im) / ss * 111000 END', 3)} AS scale, {steady_sql('CASE WHEN n >= 3 AND ss > 1.0 THEN degrees(atan2(im, re)) END', 2)} AS turn_deg FROM g""",
    "merge_transformed": f"""WITH {POINTS}, u AS (SELECT flight_id, x, y, z, tier, 1 AS part FROM point WHERE label = 1 UNION ALL SELECT flight_id, x, y, round(z + 0.02, 3), tier, 2 FROM point WHERE label <> 1)
SELECT flight_id, {', '.join(f'CAST(round_even({a} / 0.1::DOUBLE, 0) AS BIGINT) AS q{a}' for a in 'xyz')}, {steady_sql('avg(z)', 4)} AS z, min(tier) AS tier, min(part) AS part, count(*) AS n FROM u GROUP BY flight_id, {', '.join(f'round_even({a} / 0.1::DOUBLE, 0)' for a in 'xyz')}""",
    "seeded_sample": f"WITH {POINTS} SELECT flight_id, sample_id FROM point WHERE (sample_id + 42) * 2654435761 % 4294967296 < 429496730",
    "views_covering": f"""WITH {POINTS}, n AS (SELECT flight_id, CAST(floor(x / 50.0) AS BIGINT) AS ix, CAST(floor(y / 50.0) AS BIGINT) AS iy, view, count(*) AS n FROM point GROUP BY flight_id, floor(x / 50.0), floor(y / 50.0), view) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_id, ix, iy ORDER BY n DESC, view) AS rank FROM n) WHERE rank <= 3""",
    "edge_length_filter": f"""WITH {_DSM}, e AS (SELECT a.flight_id, a.row, a.col, CAST(round(sqrt(25 + (b.z - a.z) ** 2) * 1000) AS BIGINT) AS mm FROM dsm a JOIN dsm b ON b.flight_id = a.flight_id AND b.row = a.row AND b.col = a.col + 1) SELECT flight_id, row, col, mm FROM e JOIN (SELECT flight_id, quantile_cont(mm, 0.5) AS m FROM e GROUP BY ALL) USING (flight_id) WHERE mm <= 6 * m""",
}
QUERIES = {name: globals()[name] for name in SQL} | {"fix_classes": fix_classes}
