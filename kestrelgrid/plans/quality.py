"""Levels, angles, normals, priors, accuracies and the report of each flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import cross, degrees_between, dot, unit
from kestrelgrid.functions.geodesy import utm_epsg, utm_forward, utm_forward_sql
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.plans.camera import _CAMERAS, _LANDMARKS, _landmarks, cameras
from kestrelgrid.plans.estimates import SQL as ESTIMATES_SQL, checkpoint_metrics, quality_outcome
from kestrelgrid.plans.mesh import _BLOCKS, _faces
from kestrelgrid.plans.points import POINTS, SERIES, points, series
from kestrelgrid.plans.sequence import SQL as SEQUENCE_SQL, gps_grade, ground_speed_central
from kestrelgrid.plans.surface import _DSM, CELL, RES, grid_dsm
from kestrelgrid.sources.tables import table

BY = ["flight_id"]
#: Submaps are runs of views; a camera's ground is looked for within REACH metres, the low tenth of at least ENOUGH points.
SUBMAP, REACH, ENOUGH, MOST_LEVEL, SCALES = 10, 25.0, 20, 60.0, (0.1, 10.0)


#: Alignment of the map: rows (a, b, shift).
ALIGNMENT = (1.0, 0.0001, 0.4, -0.0001, 1.0, -0.3)


def submap_levels(spark: SparkSession, d: str) -> DataFrame:
    """Of each submap the median ratio of stated to seen height above ground, and how far its ground lies off; NULL beyond plausible limits.

    The ground below a camera is the tenth percentile, in millimetres, of the surface points of its submap within 25 m.
    """
    p = points(spark, d).where("alt_rel IS NOT NULL").withColumn("submap", F.floor(F.col("view") / SUBMAP).cast("bigint"))
    surface = p.select("flight_id", "submap", F.col("x").alias("px"), F.col("y").alias("py"), F.round((F.col("z") - F.col("alt_rel")) * 1000).cast("bigint").alias("mm"), *[F.floor(F.col(a) / REACH).cast("bigint").alias(f"i{a}") for a in "xy"])
    cams = p.where("alt_rel > 0").groupBy("flight_id", "submap", "view").agg(F.min_by(F.struct("x", "y", "z", "alt_rel"), "t_ms").alias("c")).select("flight_id", "submap", "view", "c.*")
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    asked = cams.withColumn("o", around).withColumns({"ix": F.floor(F.col("x") / REACH).cast("bigint") + F.col("o.i"), "iy": F.floor(F.col("y") / REACH).cast("bigint") + F.col("o.j")})
    near = asked.join(surface, ["flight_id", "submap", "ix", "iy"]).where(F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2) <= REACH * REACH)
    counts = near.groupBy("flight_id", "submap", "view", "z", "alt_rel", "mm").agg(F.count("*").alias("n"))
    ground = counts.groupBy("flight_id", "submap", "view", "z", "alt_rel").agg(F.sum("n").alias("n"), F.percentile("mm", F.lit(0.1), F.col("n")).alias("g")).where(F.col("n") >= ENOUGH)
    seen = F.col("z") - F.col("g") / 1000
    ground = ground.withColumns({"ratio": F.when(seen > 1e-6, steady(F.col("alt_rel") / seen, 6)), "off": steady(F.col("z") - F.col("alt_rel") - F.col("g") / 1000, 4)})
    g = ground.groupBy("flight_id", "submap").agg(F.count("*").alias("cameras"), F.percentile("ratio", F.lit(0.5)).alias("ratio"), F.percentile("off", F.lit(0.5)).alias("off"))
    return g.select("flight_id", "submap", "cameras", F.when(F.col("ratio").between(*SCALES), F.round("ratio", 5)).alias("scale"), F.when(F.abs("off") <= MOST_LEVEL, F.round("off", 3)).alias("level_m"))


def ray_angles(spark: SparkSession, d: str) -> DataFrame:
    """Of each view's landmark the cameras, one each 5 s, the mean and the largest angle between two of their rays, and the mean ray's rise."""
    one = cameras(spark, d).withColumn("k", F.floor(F.col("t_ms") / 5000).cast("bigint")).groupBy("flight_id", "view", "k").agg(F.min_by(F.struct("x", "y", "z"), "t_ms").alias("c"))
    j = one.join(_landmarks(spark, d), ["flight_id", "view"])
    ray = unit([F.col(f"l{a}") - F.col(f"c.{a}") for a in "xyz"])
    rays = j.select("flight_id", "view", "k", *[r.alias(a) for r, a in zip(ray, "xyz")]).where("x IS NOT NULL")
    # a view has at most four spans of 5 s
    pairs = rays.join(rays.select("flight_id", "view", F.col("k").alias("k2"), *[F.col(a).alias(f"{a}2") for a in "xyz"]), ["flight_id", "view"]).where("k < k2")
    angle = pairs.select("flight_id", "view", degrees_between(dot([F.col(a) for a in "xyz"], [F.col(f"{a}2") for a in "xyz"])).alias("deg")).groupBy("flight_id", "view").agg(steady(F.avg("deg"), 3).alias("mean_deg"), steady(F.max("deg"), 3).alias("max_deg"))
    mean = rays.groupBy("flight_id", "view").agg(F.count("*").alias("cameras"), *[F.sum(a).alias(a) for a in "xyz"])
    up = F.col("z") / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return mean.join(angle, ["flight_id", "view"], "left").select("flight_id", "view", "cameras", "mean_deg", "max_deg", steady(up, 4).alias("rise"))


def vertex_normals(spark: SparkSession, d: str) -> DataFrame:
    """Normal of every vertex of the height map's mesh: the sum of its faces' normals by their areas, of length 1, upwards."""
    f = _faces(spark, d)
    at = {k: F.col("v")[k] for k in range(3)}
    f = f.select("flight_id", *[at[k][c].alias(f"{c}{k}") for k in range(3) for c in "rc"])
    dsm = grid_dsm(spark, d).select("flight_id", "row", "col", "z")
    for k in range(3):
        f = f.join(dsm.select("flight_id", F.col("row").alias(f"r{k}"), F.col("col").alias(f"c{k}"), F.col("z").alias(f"z{k}")), ["flight_id", f"r{k}", f"c{k}"])
    side = lambda a, b: [(F.col(f"c{b}") - F.col(f"c{a}")) * RES, (F.col(f"r{a}") - F.col(f"r{b}")) * RES, F.col(f"z{b}") - F.col(f"z{a}")]
    n = cross(side(0, 1), side(0, 2))
    f = f.withColumns({f"n{a}": x for a, x in zip("xyz", n)})
    f = f.withColumns({f"n{a}": F.when(F.col("nz") < 0, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"})
    v = f.select("flight_id", "nx", "ny", "nz", F.explode(F.array(*[F.struct(F.col(f"r{k}").alias("row"), F.col(f"c{k}").alias("col")) for k in range(3)])).alias("p"))
    g = v.groupBy("flight_id", "p.row", "p.col").agg(*[F.sum(f"n{a}").alias(a) for a in "xyz"])
    return g.select("flight_id", "row", "col", *[steady(u, 5).alias(f"n{a}") for u, a in zip(unit([F.col(a) for a in "xyz"]), "xyz")])


def box_hit(origin: list[Column], direction: list[Column], low: list[Column], high: list[Column]) -> tuple[Column, Column]:
    """How far along a ray it enters an upright box, and whether it does, ahead of its origin."""
    d = [F.when(F.abs(x) < 1e-12, 1e-12).otherwise(x) for x in direction]
    a, b = ([(e - o) / x for e, o, x in zip(edge, origin, d)] for edge in (low, high))
    enter = F.greatest(*[F.least(p, q) for p, q in zip(a, b)])
    leave = F.least(*[F.greatest(p, q) for p, q in zip(a, b)])
    return enter, (leave >= enter) & (leave > 0)


def axis_hits(spark: SparkSession, d: str) -> DataFrame:
    """Whether each camera's axis meets the box of 20 m about its view's landmark, and how far away."""
    c = cameras(spark, d).join(_landmarks(spark, d), ["flight_id", "view"])
    enter, hit = box_hit([F.col(a) for a in "xyz"], [F.col(r) for r in ("r02", "r12", "r22")], [F.col(f"l{a}") - 10 for a in "xyz"], [F.col(f"l{a}") + 10 for a in "xyz"])
    return c.select("flight_id", "sample_id", hit.alias("hit"), steady(F.when(hit, enter), 2).alias("at_m"))


#: Memory of a model over n pictures of a side: weights, each picture, each pair of pictures, at the side 518; and the margin.
WEIGHTS_GB, PICTURE_GB, PAIR_GB, SIDE, MARGIN = 2.2, 0.35, 0.015, 518, 1.15


def memory_gb(n: Column, side: Column) -> Column:
    scale = F.pow(side / SIDE, 2)
    return (WEIGHTS_GB + n * PICTURE_GB * scale + n * (n - 1) / 2 * PAIR_GB * scale) * MARGIN


def window_sizes(spark: SparkSession, d: str, budget_gb: float = 6.0, wanted: int = 14, least: int = 4) -> DataFrame:
    """Window of each flight by its frames and the memory of its pictures (392, 518 or 770 pixels, by log kind): the most that fits 6 GB, the memory it takes, and the size planned."""
    n = table(spark, d, "frames").where("flight_id IS NOT NULL").select("flight_id", "frame_index").distinct().groupBy("flight_id").agg(F.count("*").alias("frames"))
    f = table(spark, d, "flights").select("flight_id", "log_kind").distinct().join(n, BY)
    side = F.when(F.col("log_kind") == "srt", 392).when(F.col("log_kind") == "csv", 518).otherwise(770)
    # the budget as a quadratic in n
    s = F.pow(side / SIDE, 2)
    a, b, c = PAIR_GB * s / 2, (PICTURE_GB - PAIR_GB / 2) * s, F.lit(WEIGHTS_GB - budget_gb / MARGIN)
    fits = F.greatest(F.lit(0), F.floor((-b + F.sqrt(b * b - 4 * a * c)) / (2 * a) + 1e-9)).cast("int")
    f = f.withColumns({"side": side, "fits": fits})
    want = F.least(F.lit(wanted), F.col("frames")).cast("int")
    planned = F.when(F.col("fits") < want, F.greatest(F.col("fits"), F.least(F.lit(least), want))).otherwise(want)
    f = f.withColumn("planned", planned)
    return f.select("flight_id", "side", "fits", "planned", steady(memory_gb(F.col("planned"), F.col("side")), 4).alias("memory_gb"))


#: Coefficients k1, k2, k3 of the lenses checked, and the radius, in focal lengths, of a picture's corner.
LENSES, CORNER = {"wide": (-0.12, 0.02, 0.0), "folded": (-0.6, 0.05, 0.0), "strong": (0.9, 0.2, 0.0), "none": (0.0, 0.0, 0.0)}, 0.75


def lens_checks(spark: SparkSession, d: str) -> DataFrame:
    """Why a lens can't be: its radius stops growing inside the picture (256 places to 5 % beyond the corner), or the corner moves by over 40 %; for each flight and lens, corners being wider for some airframes."""
    lens = spark.createDataFrame([(k, *v) for k, v in LENSES.items()], "lens string, k1 double, k2 double, k3 double")
    f = table(spark, d, "flights").select("flight_id", "airframe").distinct().withColumn("corner", F.lit(CORNER) * F.when(F.col("airframe") == "quad", 1.2).otherwise(1.0))
    f = f.withColumn("lens", F.explode(F.array(*[F.lit(k) for k in LENSES]))).join(F.broadcast(lens), "lens")
    r = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.col("corner") * 1.05 * i / 255)
    bent = F.transform(r, lambda x: x * (1 + x * x * (F.col("k1") + x * x * (F.col("k2") + x * x * F.col("k3")))))
    f = f.withColumn("bent", bent)
    folds = F.exists(F.sequence(F.lit(1), F.lit(255)), lambda i: F.get("bent", i) <= F.get("bent", i - 1))
    moved = F.abs(F.get("bent", F.lit(255)) / (F.col("corner") * 1.05) - 1)
    plain = (F.col("k1") == 0) & (F.col("k2") == 0) & (F.col("k3") == 0)
    f = f.withColumns({"folds": folds, "moved": steady(moved, 5)})
    return f.select("flight_id", "lens", F.when(plain, "fine").when(F.col("folds"), "folds over").when(F.col("moved") > 0.4, "corner").otherwise("fine").alias("verdict"), F.when(~F.col("folds"), F.col("moved")).alias("corner_moved"))


def camera_priors(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each fix as a camera's place: the stated accuracy (0.25 m at least, else 2.5 m) and the way flown in the clock's deviation, in quadrature."""
    v = ground_speed_central(spark, d)
    p = points(spark, d).join(v, ["flight_id", "t_ms"]).join(table(spark, d, "flights").select("flight_id", "log_kind").distinct(), BY)
    h = F.when(F.col("acc").isNull(), 2.5).otherwise(F.greatest(F.col("acc"), F.lit(0.25)))
    way = F.col("speed") * F.when(F.col("log_kind") == "srt", 1 / 30).otherwise(0.1)
    return p.select("flight_id", "sample_id", steady(F.sqrt(h * h + way * way), 4).alias("sigma_h"), steady(F.when(F.col("acc_v").isNull(), h).otherwise(F.greatest(F.col("acc_v"), F.lit(0.25))), 4).alias("sigma_v"))


def absolute_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy a flight may claim on the globe: the median one stated with RTK, else 3 m at least, and never better than its own scatter."""
    j = gps_grade(spark, d).join(checkpoint_metrics(spark, d).select("flight_id", "rmse_h"), BY, "left")
    bias = F.when(F.col("grade") == "RTK", F.coalesce("median_acc", F.lit(0.1))).otherwise(F.greatest(F.coalesce("median_acc", F.lit(3.0)), F.lit(3.0)))
    return j.select("flight_id", "grade", bias.alias("bias_m"), F.greatest(bias, F.coalesce("rmse_h", F.lit(0.0))).alias("accuracy_m"))


def raster_transforms(spark: SparkSession, d: str) -> DataFrame:
    """Affine transform of each flight's raster, as GDAL and as a world file write it, and the middle of its last cell."""
    box = points(spark, d).groupBy("flight_id").agg(F.min("x").alias("x0"), F.max("y").alias("y0"), F.greatest(F.lit(1), F.ceil((F.max("x") - F.min("x")) / RES)).alias("n_cols"), F.greatest(F.lit(1), F.ceil((F.max("y") - F.min("y")) / RES)).alias("n_rows"))
    x, y = F.col("x0") + RES / 2, F.col("y0") - RES / 2
    gdal = F.format_string(f"%.3f {RES:.3f} 0.000 %.3f 0.000 {-RES:.3f}", x, y)
    world = F.concat_ws("\n", F.lit(f"{RES:.3f}"), F.lit("0.000"), F.lit("0.000"), F.lit(f"{-RES:.3f}"), F.format_string("%.3f", x), F.format_string("%.3f", y))
    return box.select("flight_id", gdal.alias("gdal"), world.alias("world_file"), steady(x + RES * (F.col("n_cols") - 1), 3).alias("last_x"), steady(y - RES * (F.col("n_rows") - 1), 3).alias("last_y"))


def map_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Every fix in its flight's UTM zone, moved by an affine alignment of the map: shifted by (0.4, -0.3) m and turned by a ten-thousandth."""
    f = series(spark, d).where("geo.lat BETWEEN -80 AND 84 AND geo.lon BETWEEN -180 AND 180 AND NOT (geo.lat = 0 AND geo.lon = 0)").select("flight_id", "t_ms", "sample_id", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))
    first = f.groupBy("flight_id").agg(F.min_by(utm_epsg(F.col("lat"), F.col("lon")) % 100, "t_ms").alias("zone"))
    f = f.join(first, BY)
    e, n = utm_forward(F.col("lat"), F.col("lon"), F.col("zone"))
    f = f.withColumns({"e": e, "n": n})
    return f.select("flight_id", "sample_id", "zone", steady(F.col("e"), 2).alias("east"), steady(F.col("n"), 2).alias("north"), *[steady(x, 2).alias(k) for k, x in zip(("map_x", "map_y"), affine(F.col("e"), F.col("n"), ALIGNMENT))])


def affine(x: Column, y: Column, m: tuple[float, ...]) -> tuple[Column, Column]:
    """A place moved by the two rows (a, b, shift) of an alignment."""
    return m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]


def survey_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of each flight, a row for each figure: what was not measured says so and is never 0; the outcome is unverified where none is known."""
    p = points(spark, d).groupBy("flight_id").agg(F.count("*").alias("fixes"), F.countDistinct("view").alias("views"), *[F.count_if(F.col("tier") == k).alias(f"t{k}") for k in (2, 1, 0)])
    f = table(spark, d, "flights").select("flight_id").distinct()
    for part in (p, gps_grade(spark, d), checkpoint_metrics(spark, d).select("flight_id", "rmse_h", "rmse_v"), quality_outcome(spark, d)):
        f = f.join(part, BY, "left")
    share = lambda k: F.format_string("%.2f", steady(100 * F.col(f"t{k}") / F.col("fixes"), 2))
    figures = {
        "fixes": F.col("fixes").cast("string"), "views": F.col("views").cast("string"), "measured_pct": share(2), "low_pct": share(1), "inferred_pct": share(0),
        "rmse_h_m": F.format_string("%.3f", steady(F.col("rmse_h"), 3)), "rmse_v_m": F.format_string("%.3f", steady(F.col("rmse_v"), 3)), "median_accuracy_m": F.format_string("%.3f", steady(F.col("median_acc"), 3)), "grade": F.col("grade"),
    }
    needs = {"measured_pct": "fixes", "low_pct": "fixes", "inferred_pct": "fixes", "rmse_h_m": "rmse_h", "rmse_v_m": "rmse_v", "median_accuracy_m": "median_acc"}
    rows = [F.struct(F.lit(k).alias("figure"), F.coalesce(F.when(F.col(needs[k]).isNotNull(), v) if k in needs else v, F.lit("not computed")).alias("value")) for k, v in figures.items()]
    rows.append(F.struct(F.lit("outcome").alias("figure"), F.when(F.col("outcome").isin("failed", "unverified", "valid"), F.col("outcome")).otherwise("unverified").alias("value")))
    return f.select("flight_id", F.explode(F.array(*rows)).alias("r")).select("flight_id", "r.figure", "r.value")


_EAST, _NORTH = utm_forward_sql("lat", "lon", "zone")
_SPEED = SEQUENCE_SQL["ground_speed_central"]
_SIDE = "CASE log_kind WHEN 'srt' THEN 392 WHEN 'csv' THEN 518 ELSE 770 END"
_GB = f"({WEIGHTS_GB} + {{n}} * {PICTURE_GB} * (side / {SIDE}.0) ** 2 + {{n}} * ({{n}} - 1) / 2.0 * {PAIR_GB} * (side / {SIDE}.0) ** 2) * {MARGIN}"
_LENS = ", ".join(f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in LENSES.items())
_SLAB = {a: (f"((l{a} - 10 - {a}) / CASE WHEN abs({r}) < 1e-12 THEN 1e-12 ELSE {r} END)", f"((l{a} + 10 - {a}) / CASE WHEN abs({r}) < 1e-12 THEN 1e-12 ELSE {r} END)") for a, r in zip("xyz", ("r02", "r12", "r22"))}
SQL = {
    "submap_levels": f"""WITH {POINTS}, p AS (SELECT *, CAST(floor(view / {SUBMAP}) AS BIGINT) AS submap, round((z - alt_rel) * 1000) AS mm FROM point WHERE alt_rel IS NOT NULL), c AS (SELECT * FROM p WHERE alt_rel > 0 QUALIFY row_number() OVER (PARTITION BY flight_id, view ORDER BY t_ms) = 1),
g AS (SELECT c.flight_id, c.submap, c.view, c.z, c.alt_rel, count(*) AS n, quantile_cont(p.mm, 0.1) AS g FROM c JOIN p ON p.flight_id = c.flight_id AND p.submap = c.submap AND (p.x - c.x) ** 2 + (p.y - c.y) ** 2 <= {REACH * REACH} GROUP BY ALL HAVING count(*) >= {ENOUGH}),
r AS (SELECT *, CASE WHEN z - g / 1000 > 1e-6 THEN {steady_sql('alt_rel / (z - g / 1000)', 6)} END AS ratio, {steady_sql('z - alt_rel - g / 1000', 4)} AS off FROM g), m AS (SELECT flight_id, submap, count(*) AS cameras, quantile_cont(ratio, 0.5) AS ratio, quantile_cont(off, 0.5) AS off FROM r GROUP BY ALL)
SELECT flight_id, submap, cameras, CASE WHEN ratio BETWEEN {SCALES[0]} AND {SCALES[1]} THEN round(ratio, 5) END AS scale, CASE WHEN abs(off) <= {MOST_LEVEL} THEN round(off, 3) END AS level_m FROM m""",
    "ray_angles": f"""WITH {_CAMERAS}, {_LANDMARKS}, o AS (SELECT * FROM camera QUALIFY row_number() OVER (PARTITION BY flight_id, view, floor(t_ms / 5000) ORDER BY t_ms) = 1), v AS (SELECT o.flight_id, o.view, t_ms, lx - x AS x, ly - y AS y, lz - z AS z, sqrt((lx - x) ** 2 + (ly - y) ** 2 + (lz - z) ** 2) AS n FROM o JOIN landmark USING (flight_id, view)),
u AS (SELECT flight_id, view, t_ms, x / n AS x, y / n AS y, z / n AS z FROM v WHERE n > 1e-9), a AS (SELECT a.flight_id, a.view, degrees(acos(greatest(-1.0, least(1.0, a.x * b.x + a.y * b.y + a.z * b.z)))) AS deg FROM u a JOIN u b ON b.flight_id = a.flight_id AND b.view = a.view AND b.t_ms > a.t_ms),
g AS (SELECT flight_id, view, {steady_sql('avg(deg)', 3)} AS mean_deg, {steady_sql('max(deg)', 3)} AS max_deg FROM a GROUP BY ALL), s AS (SELECT flight_id, view, count(*) AS cameras, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM u GROUP BY ALL) SELECT flight_id, view, cameras, mean_deg, max_deg, {steady_sql('z / sqrt(x * x + y * y + z * z)', 4)} AS rise FROM s LEFT JOIN g USING (flight_id, view)""",
    "vertex_normals": f"""WITH {_DSM}, {_BLOCKS}, q AS (SELECT b.flight_id, r, c, d00.z AS z00, d01.z AS z01, d10.z AS z10, d11.z AS z11 FROM b JOIN dsm d00 ON d00.flight_id = b.flight_id AND d00.row = r AND d00.col = c JOIN dsm d01 ON d01.flight_id = b.flight_id AND d01.row = r AND d01.col = c + 1
  JOIN dsm d10 ON d10.flight_id = b.flight_id AND d10.row = r + 1 AND d10.col = c JOIN dsm d11 ON d11.flight_id = b.flight_id AND d11.row = r + 1 AND d11.col = c + 1),
t AS (SELECT flight_id, r, c, -{RES} * (z01 - z00) AS nx, {RES} * (z10 - z00) AS ny, unnest([[0, 0], [0, 1], [1, 0]]) AS p FROM q UNION ALL SELECT flight_id, r, c, -{RES} * (z11 - z10), {RES} * (z11 - z01), unnest([[1, 1], [1, 0], [0, 1]]) FROM q),
s AS (SELECT flight_id, r + p[1] AS row, c + p[2] AS col, sum(nx) AS x, sum(ny) AS y, sum({RES * RES}) AS z FROM t GROUP BY ALL) SELECT flight_id, row, col, {', '.join(f"{steady_sql(f'{a} / sqrt(x * x + y * y + z * z)', 5)} AS n{a}" for a in 'xyz')} FROM s""",
    "axis_hits": f"""WITH {_CAMERAS}, {_LANDMARKS}, s AS (SELECT flight_id, sample_id, greatest({', '.join(f'least({a}, {b})' for a, b in _SLAB.values())}) AS enter, least({', '.join(f'greatest({a}, {b})' for a, b in _SLAB.values())}) AS leave FROM camera JOIN landmark USING (flight_id, view))
SELECT flight_id, sample_id, leave >= enter AND leave > 0 AS hit, CASE WHEN leave >= enter AND leave > 0 THEN {steady_sql('enter', 2)} END AS at_m FROM s""",
    "window_sizes": f"""WITH n AS (SELECT flight_id, count(DISTINCT frame_index) AS frames FROM frames WHERE flight_id IS NOT NULL GROUP BY ALL), f AS (SELECT DISTINCT flight_id, {_SIDE} AS side, frames FROM flights JOIN n USING (flight_id)),
m AS (SELECT flight_id, side, frames, count(*) FILTER ({_GB.format(n='k')} <= 6.0) AS fits FROM f, range(1, 1000) r(k) GROUP BY ALL), w AS (SELECT *, least(14, frames) AS want FROM m), p AS (SELECT *, CASE WHEN fits < want THEN greatest(fits, least(4, want)) ELSE want END AS planned FROM w)
SELECT flight_id, side, CAST(fits AS INTEGER) AS fits, CAST(planned AS INTEGER) AS planned, {steady_sql(_GB.format(n='planned'), 4)} AS memory_gb FROM p""",
    "lens_checks": f"""WITH f AS (SELECT DISTINCT flight_id, {CORNER} * CASE WHEN airframe = 'quad' THEN 1.2 ELSE 1.0 END AS corner FROM flights), l(lens, k1, k2, k3) AS (VALUES {_LENS}), r AS (SELECT flight_id, lens, k1, k2, k3, corner, i, corner * 1.05 * i / 255 AS r FROM f, l, range(256) x(i)),
b AS (SELECT *, r * (1 + r * r * (k1 + r * r * (k2 + r * r * k3))) AS bent FROM r), s AS (SELECT *, bent <= lag(bent) OVER (PARTITION BY flight_id, lens ORDER BY i) AS down FROM b),
g AS (SELECT flight_id, lens, any_value(k1 = 0 AND k2 = 0 AND k3 = 0) AS plain, coalesce(bool_or(down), false) AS folds, {steady_sql('abs(max(CASE WHEN i = 255 THEN bent / (corner * 1.05) END) - 1)', 5)} AS moved FROM s GROUP BY ALL)
SELECT flight_id, lens, CASE WHEN plain THEN 'fine' WHEN folds THEN 'folds over' WHEN moved > 0.4 THEN 'corner' ELSE 'fine' END AS verdict, CASE WHEN NOT folds THEN moved END AS corner_moved FROM g""",
    "camera_priors": f"""WITH s AS ({_SPEED}), {POINTS}, h AS (SELECT p.flight_id, sample_id, CASE WHEN acc IS NULL THEN 2.5 ELSE greatest(acc, 0.25) END AS h, acc_v, speed * CASE WHEN log_kind = 'srt' THEN 1 / 30 ELSE 0.1 END AS way FROM point p JOIN s ON s.flight_id = p.flight_id AND s.t_ms = p.t_ms JOIN (SELECT DISTINCT flight_id, log_kind FROM flights) f ON f.flight_id = p.flight_id)
SELECT flight_id, sample_id, {steady_sql('sqrt(h * h + way * way)', 4)} AS sigma_h, {steady_sql('CASE WHEN acc_v IS NULL THEN h ELSE greatest(acc_v, 0.25) END', 4)} AS sigma_v FROM h""",
    "absolute_accuracy": f"""WITH g AS ({SEQUENCE_SQL['gps_grade']}), c AS ({ESTIMATES_SQL['checkpoint_metrics']}), b AS (SELECT g.flight_id, grade, CASE WHEN grade = 'RTK' THEN coalesce(median_acc, 0.1) ELSE greatest(coalesce(median_acc, 3.0), 3.0) END AS bias_m, rmse_h FROM g LEFT JOIN c ON c.flight_id = g.flight_id)
SELECT flight_id, grade, bias_m, greatest(bias_m, coalesce(rmse_h, 0.0)) AS accuracy_m FROM b""",
    "raster_transforms": f"""WITH {POINTS}, b AS (SELECT flight_id, min(x) + {RES / 2} AS x, max(y) - {RES / 2} AS y, greatest(1, ceil((max(x) - min(x)) / {RES})) AS n_cols, greatest(1, ceil((max(y) - min(y)) / {RES})) AS n_rows FROM point GROUP BY flight_id)
SELECT flight_id, printf('%.3f {RES:.3f} 0.000 %.3f 0.000 {-RES:.3f}', x, y) AS gdal, printf('{RES:.3f}' || chr(10) || '0.000' || chr(10) || '0.000' || chr(10) || '{-RES:.3f}' || chr(10) || '%.3f' || chr(10) || '%.3f', x, y) AS world_file, {steady_sql(f'x + {RES} * (n_cols - 1)', 3)} AS last_x, {steady_sql(f'y - {RES} * (n_rows - 1)', 3)} AS last_y FROM b""",
    "map_coordinates": f"""WITH {SERIES}, f AS (SELECT flight_id, t_ms, sample_id, geo.lat AS lat, geo.lon AS lon FROM series WHERE geo.lat BETWEEN -80 AND 84 AND geo.lon BETWEEN -180 AND 180 AND NOT (geo.lat = 0 AND geo.lon = 0)),
z AS (SELECT flight_id, arg_min(CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lon >= 33 AND lon < 42 THEN 37 ELSE least(floor((lon + 180) / 6) + 1, 60) END, t_ms) AS zone FROM f GROUP BY ALL),
u AS (SELECT f.flight_id, sample_id, CAST(zone AS INTEGER) AS zone, {_EAST} AS e, {_NORTH} AS n FROM f JOIN z ON z.flight_id = f.flight_id)
SELECT flight_id, sample_id, zone, {steady_sql('e', 2)} AS east, {steady_sql('n', 2)} AS north, {steady_sql('1.0 * e + 0.0001 * n + 0.4', 2)} AS map_x, {steady_sql('-0.0001 * e + 1.0 * n - 0.3', 2)} AS map_y FROM u""",
    "survey_report": f"""WITH g AS ({SEQUENCE_SQL['gps_grade']}), c AS ({ESTIMATES_SQL['checkpoint_metrics']}), q AS ({ESTIMATES_SQL['quality_outcome']}), {POINTS}, p AS (SELECT flight_id, count(*) AS fixes, count(DISTINCT view) AS views, count(*) FILTER (tier = 2) AS t2, count(*) FILTER (tier = 1) AS t1, count(*) FILTER (tier = 0) AS t0 FROM point GROUP BY ALL),
j AS (SELECT f.flight_id, fixes, views, t2, t1, t0, median_acc, grade, rmse_h, rmse_v, outcome FROM (SELECT DISTINCT flight_id FROM flights) f LEFT JOIN p ON p.flight_id = f.flight_id LEFT JOIN g ON g.flight_id = f.flight_id LEFT JOIN c ON c.flight_id = f.flight_id LEFT JOIN q ON q.flight_id = f.flight_id)
SELECT flight_id, figure, coalesce(value, 'not computed') AS value FROM (
  SELECT flight_id, 'fixes' AS figure, CAST(fixes AS VARCHAR) AS value FROM j UNION ALL SELECT flight_id, 'views', CAST(views AS VARCHAR) FROM j UNION ALL SELECT flight_id, 'measured_pct', CASE WHEN fixes IS NOT NULL THEN printf('%.2f', {steady_sql('100.0 * t2 / fixes', 2)}) END FROM j UNION ALL SELECT flight_id, 'low_pct', CASE WHEN fixes IS NOT NULL THEN printf('%.2f', {steady_sql('100.0 * t1 / fixes', 2)}) END FROM j
  UNION ALL SELECT flight_id, 'inferred_pct', CASE WHEN fixes IS NOT NULL THEN printf('%.2f', {steady_sql('100.0 * t0 / fixes', 2)}) END FROM j UNION ALL SELECT flight_id, 'rmse_h_m', CASE WHEN rmse_h IS NOT NULL THEN printf('%.3f', {steady_sql('rmse_h', 3)}) END FROM j UNION ALL SELECT flight_id, 'rmse_v_m', CASE WHEN rmse_v IS NOT NULL THEN printf('%.3f', {steady_sql('rmse_v', 3)}) END FROM j
  UNION ALL SELECT flight_id, 'median_accuracy_m', CASE WHEN median_acc IS NOT NULL THEN printf('%.3f', {steady_sql('median_acc', 3)}) END FROM j UNION ALL SELECT flight_id, 'grade', grade FROM j UNION ALL SELECT flight_id, 'outcome', coalesce(outcome, 'unverified') FROM j)""",
}
QUERIES = {name: globals()[name] for name in SQL}
