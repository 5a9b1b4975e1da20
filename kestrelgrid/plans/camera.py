"""Cameras along the flights: rotations, projections, similarities, covariances, lenses, and the gates on them.

A camera is a fix with the gimbal's angles; its heading is a compass heading, a missing roll is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import IDENTITY, ahead, axis_of, degrees_between, directions_offered, dot, flat, focal_of_view, gimbal_rotation, gravity_error, in_camera, new_direction, pixel, rotated, rotation_change, semi_axes, settled_share, similar, similar_covariance, turned, unit, up_in_camera
from kestrelgrid.functions.geodesy import wrap_degrees
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.functions.tokens import byte_of_share, epoch_seconds, flag, number_or_fraction
from kestrelgrid.operators.grid import counted_median
from kestrelgrid.operators.split_windows import neighbours
from kestrelgrid.plans.points import POINTS, points
from kestrelgrid.plans.sequence import _FRAMES, _RUNS, SQL as SEQUENCE_SQL, frame_sequence, resample_interpolate, segment_offset
from kestrelgrid.sources.tables import table

BY = ["flight_id"]
R = [f"r{i}{j}" for i in range(3) for j in range(3)]
#: The camera of the projections: focal lengths, centre and size in pixels, and its lens.
FOCAL, CENTRE, SIZE, LENS = (1600.0, 1590.0), (960.0, 540.0), (1920, 1080), (-0.1, 0.01, 0.001, -0.0005, 0.002)
#: The similarity of the merges: scale, the angles of its rotation, shift.
SCALE, ANGLES, SHIFT = 1.02, (30.0, 5.0, -10.0), (100.0, -50.0, 5.0)


def _cols(names: list[str], prefix: str = "") -> list[Column]:
    return [F.col(prefix + n) for n in names]


def cameras(spark: SparkSession, d: str) -> DataFrame:
    """Fixes with known gimbal angles; adds the rotation r00 to r22."""
    p = points(spark, d).where("yaw IS NOT NULL AND pitch IS NOT NULL AND NOT isnan(yaw) AND NOT isnan(pitch)").withColumn("roll", F.coalesce("roll", F.lit(0.0)))
    return p.withColumns(dict(zip(R, gimbal_rotation(-F.col("yaw"), F.col("pitch"), F.col("roll")))))


def camera_rotations(spark: SparkSession, d: str) -> DataFrame:
    """Rotation of every camera, the world's up in its frame, and where it looks without its roll."""
    c = cameras(spark, d)
    up, to = up_in_camera(F.col("pitch"), F.col("roll")), ahead(-F.col("yaw"), F.col("pitch"))
    return c.select("flight_id", "sample_id", *[steady(F.col(r), 6).alias(r) for r in R], *[steady(u, 6).alias(f"up_{k}") for u, k in zip(up, "xyz")], *[steady(a, 6).alias(f"ahead_{k}") for a, k in zip(to, "enu")])


def camera_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turn of each camera from the one before, and whether a pure shift between them would keep gravity within 3 degrees."""
    c = neighbours(cameras(spark, d), BY, ["t_ms"], "bucket", R).where("prev IS NOT NULL")
    before, own = _cols(R, "prev."), _cols(R)
    out = c.select("flight_id", "sample_id", steady(rotation_change(before, own), 3).alias("turn_deg"), steady(gravity_error([F.lit(x) for x in IDENTITY], before, own), 3).alias("tilt_deg"))
    return out.withColumn("gravity_kept", F.col("tilt_deg") <= 3)


def _landmarks(spark: SparkSession, d: str) -> DataFrame:
    """(flight_id, view, lx, ly, lz): the ground below the middle of each view's path."""
    g = points(spark, d).where("alt_rel IS NOT NULL").groupBy("flight_id", "view")
    return g.agg(*[steady(F.avg(a), 3).alias(f"l{a}") for a in "xy"], steady(F.avg(F.col("z") - F.col("alt_rel")), 3).alias("lz"))


def landmark_projection(spark: SparkSession, d: str) -> DataFrame:
    """Where each camera sees its view's landmark: depth, pixel through the lens, whether that is in the picture; pixels only within 63 degrees of the axis."""
    c = cameras(spark, d).join(_landmarks(spark, d), ["flight_id", "view"])
    seen = in_camera(_cols(R), _cols(["x", "y", "z"]), _cols(["lx", "ly", "lz"]))
    c = c.withColumns(dict(zip(("sx", "sy", "sz"), seen)))
    fx, fy, depth = flat(_cols(["sx", "sy", "sz"]))
    c = c.withColumns({"fx": fx, "fy": fy})
    near = (F.abs("fx") <= 2) & (F.abs("fy") <= 2)
    u, v = pixel(F.col("fx"), F.col("fy"), [F.lit(x) for x in FOCAL], [F.lit(x) for x in CENTRE], [F.lit(x) for x in LENS])
    c = c.select("flight_id", "sample_id", steady(depth, 3).alias("depth"), steady(F.when(near, u), 2).alias("u"), steady(F.when(near, v), 2).alias("v"))
    return c.withColumn("in_picture", F.coalesce((F.col("u") >= 0) & (F.col("u") < SIZE[0]) & (F.col("v") >= 0) & (F.col("v") < SIZE[1]), F.lit(False)))


def similarity_poses(spark: SparkSession, d: str) -> DataFrame:
    """Cameras moved by a similarity: centre and axis, the pose turned inside out, and the covariance of the accuracies."""
    c = cameras(spark, d)
    m = gimbal_rotation(*[F.lit(a) for a in ANGLES])
    moved = similar(F.lit(SCALE), m, [F.lit(x) for x in SHIFT], _cols(["x", "y", "z"]))
    axis, back = rotated(m, _cols(["r02", "r12", "r22"])), [-x for x in rotated(turned(_cols(R)), _cols(["x", "y", "z"]))]
    h, v = F.col("acc") * F.col("acc"), F.col("acc_v") * F.col("acc_v")
    none = F.lit(0.0)
    cov = similar_covariance(F.lit(SCALE), m, [h, none, none, none, h, none, none, none, v])
    return c.select(
        "flight_id", "sample_id", *[steady(a, 3).alias(k) for a, k in zip(moved, "xyz")], *[steady(a, 6).alias(f"axis_{k}") for a, k in zip(axis, "xyz")], *[steady(a, 3).alias(f"back_{k}") for a, k in zip(back, "xyz")],
        *[steady(cov[k], 4).alias(n) for k, n in ((0, "cxx"), (4, "cyy"), (8, "czz"), (1, "cxy"), (2, "cxz"), (5, "cyz"))], steady(F.col("acc") * SCALE, 4).alias("sigma"),
    )


def prior_sigmas(spark: SparkSession, d: str) -> DataFrame:
    """Deviations a camera's position may have from its fix: the stated accuracies, 0.25 m at least, else 2.5 m; heights as stated, else as the plane."""
    h = F.coalesce(F.greatest(F.col("acc"), F.when(F.col("acc").isNotNull(), 0.25)), F.lit(2.5))
    v = F.coalesce(F.greatest(F.col("acc_v"), F.when(F.col("acc_v").isNotNull(), 0.25)), h)
    return points(spark, d).select("flight_id", "sample_id", h.alias("sigma_e"), h.alias("sigma_n"), v.alias("sigma_u"))


_COV = ["xx", "yy", "zz", "xy", "xz", "yz"]


def _ellipsoids(spark: SparkSession, d: str) -> DataFrame:
    """Covariance of the fixes of each view of three or more, its half axes and its first direction where one axis is longest by 1 %."""
    g = points(spark, d).groupBy("flight_id", "view").agg(F.count("*").alias("n"), *[F.covar_pop(k[0], k[1]).alias(k) for k in _COV], *[F.avg(a).alias(f"m{a}") for a in "xyz"])
    g = g.where("n >= 3").withColumns(dict(zip(("s1", "s2", "s3"), semi_axes(*_cols(_COV)))))
    axis = axis_of(F.col("s1") * F.col("s1"), *_cols(_COV))
    return g.withColumns({f"w{k}": F.when(F.col("s1") > 1.01 * F.col("s2"), a) for k, a in zip("xyz", axis)})


def view_ellipsoids(spark: SparkSession, d: str) -> DataFrame:
    """Half axes of each view's fixes, how much longer the first is than the last, and the tier of the first: 5 cm and 50 cm."""
    e = _ellipsoids(spark, d).select("flight_id", "view", "n", *[steady(F.col(s), 3).alias(s) for s in ("s1", "s2", "s3")])
    tier = F.when(F.col("s1") <= 0.05, 2).when(F.col("s1") <= 0.5, 1).otherwise(0)
    return e.select("*", F.when(F.col("s3") > 0, steady(F.col("s1") / F.col("s3"), 4)).alias("anisotropy"), tier.alias("tier"))


def viewing_needs(spark: SparkSession, d: str) -> DataFrame:
    """For each view's landmark the angle between the worst axis and the mean ray, whether path and ray had to tell the new direction, its height, and what a view from there settles; NULL where no axis or ray stands out."""
    e = _ellipsoids(spark, d).join(_landmarks(spark, d), ["flight_id", "view"])
    ends = points(spark, d).groupBy("flight_id", "view").agg(F.min(F.struct("t_ms", "x", "y", "z")).alias("a"), F.max(F.struct("t_ms", "x", "y", "z")).alias("b"))
    e = e.join(ends, ["flight_id", "view"])
    ray = unit([F.col(f"l{k}") - F.col(f"m{k}") for k in "xyz"])
    path = unit([F.col(f"b.{k}") - F.col(f"a.{k}") for k in "xyz"])
    e = e.withColumns({**{f"v{k}": r for k, r in zip("xyz", ray)}, **{f"p{k}": F.coalesce(p, F.lit(0.0)) for k, p in zip("xyz", path)}})
    w, v, p = (_cols([f"{a}{k}" for k in "xyz"]) for a in "wvp")
    e = e.withColumns({"along": steady(F.abs(dot(w, v)), 4), "offers": directions_offered(w, v, p)})
    e = e.withColumn("d", new_direction(F.col("offers"), F.col("along")))
    turn = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(_cols(["d.x", "d.y", "d.z"]), v))))
    known = lambda c: F.when(F.col("along").isNotNull(), c)
    return e.select("flight_id", "view", "along", steady(degrees_between(F.col("along")), 2).alias("angle_deg"), (F.col("along") > 0.85).alias("by_path"), known(steady(F.abs("d.z"), 3)).alias("rise"), known(steady(settled_share(turn), 3)).alias("settles"))


def tiers_of(df: DataFrame, name: str) -> DataFrame:
    """Adds <name>_tier: 2 from 0.8, 1 from 0.3, else 0; a column that only holds 0, 1 and 2 is tiers already and stays."""
    done = df.agg(F.coalesce(F.bool_and(F.col(name).isin(0.0, 1.0, 2.0)), F.lit(True)).alias("done"))
    c = F.col(name)
    return df.crossJoin(F.broadcast(done)).withColumn(f"{name}_tier", F.when(F.col("done"), c.cast("int")).when(c >= 0.8, 2).when(c >= 0.3, 1).when(c.isNotNull(), 0)).drop("done")


def confidence_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of a confidence that falls with the accuracy, of tiers that stay what they are, and the confidence as a byte."""
    p = points(spark, d).where("acc >= 0").select("flight_id", "sample_id", (1 / (1 + F.col("acc"))).alias("raw"), F.col("tier").cast("double").alias("held"))
    t = tiers_of(tiers_of(p, "raw"), "held")
    return t.select("flight_id", "sample_id", "raw_tier", "held_tier", byte_of_share(F.round("raw", 6)).alias("raw_byte"))


def flight_intrinsics(spark: SparkSession, d: str) -> DataFrame:
    """Camera of each flight and where it is known from: stated by the operator (calibrated 3,840 pixels wide) for sidecar logs, from the airframe's field of view, else 84 degrees; at half size, and with its focal length corrected by 5 %."""
    width, views = 1920, {"quad": 78.0, "fixed-wing": 62.0, "vtol": 70.0}
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in views.items() for x in kv]), F.lower(F.trim("airframe")))
    source = F.when(F.col("log_kind") == "srt", "user").when(known.isNotNull(), "camera_db").otherwise("default_guess")
    stated = F.lit(3000.0) * width / 3840
    fx = F.when(source == "user", stated).otherwise(focal_of_view(F.coalesce(known, F.lit(84.0)), F.lit(float(width))))
    f = table(spark, d, "flights").select("flight_id", "airframe", "log_kind").distinct()
    return f.select("flight_id", source.alias("source"), F.round(fx, 6).alias("fx"), F.lit(width / 2).alias("cx"), F.round(fx / 2, 6).alias("half_fx"), F.lit(width / 4).alias("half_cx"), F.round(fx * 1.05, 6).alias("corrected_fx"))


def corrected_values(spark: SparkSession, d: str) -> DataFrame:
    """Brightness of the frames by the gain of their 10 s, 0.4 to 2.5, cut off at 255."""
    f = table(spark, d, "frames").where("flight_id IS NOT NULL AND mean_luma IS NOT NULL AND NOT isnan(mean_luma) AND t >= 0 AND t < 9e12").select("flight_id", "frame_index", "mean_luma", F.floor(F.col("t") / 10).cast("bigint").alias("span")).distinct()
    gain = f.groupBy("flight_id", "span").agg(steady(F.greatest(F.lit(0.4), F.least(F.lit(2.5), 100 / F.avg("mean_luma"))), 6).alias("gain"))
    return f.join(gain, ["flight_id", "span"]).select("flight_id", "frame_index", "gain", steady(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("mean_luma") * F.col("gain"))), 4).alias("luma"))


def corrected_depths(spark: SparkSession, d: str) -> DataFrame:
    """Heights above take-off as depths, scaled by 1.02 and moved by 0.5 m; what isn't above 0 is 0."""
    a = F.when(F.col("alt_rel") > 1e-6, 1.02 * F.col("alt_rel") + 0.5).otherwise(0.0)
    return points(spark, d).where("alt_rel IS NOT NULL").select("flight_id", "sample_id", steady(F.when(a > 1e-6, a).otherwise(0.0), 4).alias("depth"))


def flow_headings(spark: SparkSession, d: str) -> DataFrame:
    """The heading, of each 30 degrees, under which the ground would move through the picture as it does under the gimbal's own."""
    c = neighbours(cameras(spark, d), BY, ["t_ms"], "bucket", ["x", "y"]).where("prev IS NOT NULL")
    way = [F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y"), F.lit(0.0)]
    c = c.where(dot(way, way) > 1).select("flight_id", "sample_id", "yaw", "pitch", "roll", *[w.alias(f"w{k}") for w, k in zip(way, "xyz")], *R)

    def flow(m: list[Column]) -> Column:
        seen = rotated(turned(m), _cols(["wx", "wy", "wz"]))
        return F.degrees(F.atan2(-seen[1], -seen[0]))

    offers = [F.struct(steady(F.abs(wrap_degrees(flow(gimbal_rotation(F.lit(float(-h)), F.col("pitch"), F.col("roll"))) - F.col("own"))), 3).alias("off"), F.lit(h).alias("heading")) for h in range(0, 360, 30)]
    best = c.withColumn("own", flow(_cols(R))).withColumn("best", F.array_min(F.array(*offers)))
    return best.select("flight_id", "sample_id", F.col("best.heading").alias("heading"), F.col("best.off").alias("off_deg"))


def useful_baseline(raw: Column, deviation: Column, known_camera: Column, residual: Column, inliers: Column) -> Column:
    """Pixels of motion that help a reconstruction: none below the noise of 0.3; with a known camera none where the motion is a pure rotation (deviation under 0.005); without one none under 2 pixels or where a plane explains all of it."""
    by_camera = F.when(deviation < 0.005, 0.0).otherwise(raw)
    by_fit = F.when(raw < 2.0, 0.0).when((residual > 0.05) | (inliers < 0.5), raw).otherwise(0.0)
    return F.when(raw < 0.3, 0.0).when(known_camera, by_camera).otherwise(by_fit)


def frame_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Useful parallax of the frames: with a camera where the frame is sharp, by residual and inliers elsewhere."""
    f = table(spark, d, "frames").where("flight_id IS NOT NULL AND parallax IS NOT NULL AND NOT isnan(parallax)").select("flight_id", "frame_index", "parallax", "exposure_score", "blur_score").distinct()
    sharp = F.coalesce(F.col("blur_score") >= 100, F.lit(False))
    use = useful_baseline(F.col("parallax"), F.col("exposure_score") / 50, sharp, F.col("parallax") / 40, F.col("exposure_score"))
    return f.select("flight_id", "frame_index", F.round(use, 6).alias("useful_px"))


def clock_gates(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of each flight's clock (a frame for sidecar logs, else 0.1 s), the height of its local origin, and whether it is refused for a clock that was only assumed."""
    f = table(spark, d, "flights").select("flight_id", "log_kind").distinct()
    first = points(spark, d).groupBy("flight_id").agg(F.min_by("alt_msl", "t_ms").alias("datum_m"))
    j = f.join(first, BY, "left").join(segment_offset(spark, d).select("flight_id", "source"), BY, "left")
    refused = F.col("log_kind").isin("csv", "gpx") & (F.col("source") == "assumed_zero")
    return j.select("flight_id", F.round(F.when(F.col("log_kind") == "srt", 1 / 30).otherwise(0.1), 6).alias("sigma_s"), "datum_m", F.coalesce(refused, F.lit(False)).alias("refused"))


def reconstruction_ready(spark: SparkSession, d: str) -> DataFrame:
    """Which surfaces each flight's frames allow: three placed frames and 70 % of all, and for heights from above a median tilt within 20 degrees; and whether the gimbal is over 30 degrees off straight down."""
    n = resample_interpolate(spark, d).groupBy("flight_id").agg(F.count("*").alias("frames"), F.count("x").alias("placed"))
    tilt = cameras(spark, d).withColumns({"tilt": F.round(degrees_between(-F.col("r22")) * 1000).cast("bigint"), "p": F.round(F.col("pitch") * 1000).cast("bigint")})
    m = counted_median(tilt, BY, "tilt").join(counted_median(tilt, BY, "p").withColumnRenamed("m", "p"), BY)
    j = n.join(m, BY, "left")
    full = (F.col("placed") >= 3) & (F.col("placed") >= 0.7 * F.col("frames"))
    nadir = F.coalesce(F.col("m") <= 20_000, F.lit(False))
    return j.select("flight_id", "frames", "placed", full.alias("surface_ready"), (full & nadir).alias("heights_ready"), F.coalesce(F.abs(F.col("p") + 90_000) > 30_000, F.lit(False)).alias("not_nadir"))


def camera_validation(spark: SparkSession, d: str) -> DataFrame:
    """Cameras smoothed over their neighbours against the cameras as logged: shifts, turns, and the scale of baselines over 10 m, each against its limit; ``failures`` names the limits passed."""
    c = neighbours(cameras(spark, d), BY, ["t_ms"], "bucket", ["x", "y", "z", *R]).where("prev IS NOT NULL AND next IS NOT NULL")
    mid = {k: (F.col(f"prev.{k}") + F.col(k) + F.col(f"next.{k}")) / 3 for k in "xyz"}
    c = c.withColumns({f"m{k}": v for k, v in mid.items()})
    shift = F.sqrt(sum((F.pow(F.col(k) - F.col(f"m{k}"), 2) for k in "xyz"), F.lit(0.0)))
    base = lambda p: F.sqrt(sum((F.pow(F.col(p + k) - F.col(f"last.{p}{k}"), 2) for k in "xyz"), F.lit(0.0)))
    first = c.groupBy("flight_id", "view").agg(F.min_by(F.struct(*"xyz", "mx", "my", "mz"), "t_ms").alias("f")).select("flight_id", "view", "f.*")
    after = first.select("flight_id", (F.col("view") + 1).alias("view"), F.struct(*"xyz", "mx", "my", "mz").alias("last"))
    ratios = first.join(after, ["flight_id", "view"]).where(base("") >= 10).select("flight_id", F.round(base("m") / base("") * 10_000).cast("bigint").alias("ratio"))
    c = c.select("flight_id", F.round(shift * 1000).cast("bigint").alias("shift"), F.round(rotation_change(_cols(R, "prev."), _cols(R)) * 1000).cast("bigint").alias("turn"))
    g = c.groupBy("flight_id").agg(F.max("shift").alias("max_shift"), F.max("turn").alias("max_turn"))
    for k in ("shift", "turn"):
        g = g.join(counted_median(c, BY, k).withColumnRenamed("m", f"median_{k}"), BY)
    g = g.join(counted_median(ratios, BY, "ratio").withColumnRenamed("m", "scale"), BY, "left")
    limits = {"median shift": F.col("median_shift") > 15_000, "max shift": F.col("max_shift") > 30_000, "median turn": F.col("median_turn") > 15_000, "max turn": F.col("max_turn") > 30_000, "baseline scale": ~F.col("scale").between(8_000, 12_500)}
    return g.select("flight_id", *[(F.col(k) / 1000).alias(k) for k in ("median_shift", "max_shift", "median_turn", "max_turn")], (F.col("scale") / 10_000).alias("scale"), F.concat_ws(", ", *[F.when(c, name) for name, c in limits.items()]).alias("failures"))


def text_values(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy cells as numbers and fractions of the other cell, notes as flags, and delivery times read back from text."""
    r = table(spark, d, "accuracy_readings").select("reading_id", "accuracy_h", "accuracy_v", "note", "received_at").distinct()
    fraction = F.concat_ws("/", F.col("accuracy_h"), F.col("accuracy_v"))
    return r.select(
        "reading_id", number_or_fraction(F.col("accuracy_h")).alias("number"), F.round(number_or_fraction(F.when(F.col("accuracy_h").isNotNull() & F.col("accuracy_v").isNotNull(), fraction)), 6).alias("ratio"),
        flag(F.coalesce("note", F.when(F.col("accuracy_v") == "12 sats", F.lit(" Yes")))).alias("flagged"), epoch_seconds(F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("received_s"),
    ).groupBy("reading_id").agg(F.max("number").alias("number"), F.max("ratio").alias("ratio"), F.max("flagged").alias("flagged"), F.max("received_s").alias("received_s"))


_CAMERAS = f"""{POINTS}, angle AS (SELECT *, coalesce(roll, 0.0) AS rl, radians(-yaw) AS a, radians(pitch) AS b, radians(coalesce(roll, 0.0)) AS c FROM point WHERE yaw IS NOT NULL AND pitch IS NOT NULL AND NOT isnan(yaw) AND NOT isnan(pitch)),
camera AS (SELECT *, cos(a) * cos(c) - sin(a) * sin(b) * sin(c) AS r00, -cos(a) * sin(c) - sin(a) * sin(b) * cos(c) AS r01, -sin(a) * cos(b) AS r02,
  sin(a) * cos(c) + cos(a) * sin(b) * sin(c) AS r10, -sin(a) * sin(c) + cos(a) * sin(b) * cos(c) AS r11, cos(a) * cos(b) AS r12, -cos(b) * sin(c) AS r20, -cos(b) * cos(c) AS r21, sin(b) AS r22 FROM angle)"""
_LAG = ", ".join(f"lag({k}) OVER w AS {k}_" for k in (*R, "x", "y", "z"))
_LEAD = ", ".join(f"lead({k}) OVER w AS n{k}" for k in "xyz")
_BEFORE = f"before AS (SELECT *, {_LAG}, {_LEAD}, lag(sample_id) OVER w AS id_, lead(sample_id) OVER w AS nid FROM camera WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms))"
_TURN = "degrees(acos(greatest(-1.0, least(1.0, (" + " + ".join(f"{r} * {r}_" for r in R) + " - 1) / 2))))"
_TILT = "degrees(acos(greatest(-1.0, least(1.0, (r20 * r20_ + r21 * r21_ + r22 * r22_) / (sqrt(r20 ** 2 + r21 ** 2 + r22 ** 2) * sqrt(r20_ ** 2 + r21_ ** 2 + r22_ ** 2))))))"
_LANDMARKS = f"landmark AS (SELECT flight_id, view, {steady_sql('avg(x)', 3)} AS lx, {steady_sql('avg(y)', 3)} AS ly, {steady_sql('avg(z - alt_rel)', 3)} AS lz FROM point WHERE alt_rel IS NOT NULL GROUP BY ALL)"


def _turned(m: str, v: str) -> list[str]:
    """The rows of a transposed matrix times a vector, as SQL: m and v are prefixes of their columns."""
    return ["(" + " + ".join(f"{m}{i}{j} * {v}{k}" for i, k in enumerate("xyz")) + ")" for j in range(3)]


def _fixed_rotation() -> list[list[float]]:
    import math

    (cy, sy), (cp, sp), (cr, sr) = ((math.cos(math.radians(a)), math.sin(math.radians(a))) for a in ANGLES)
    return [[cy * cr - sy * sp * sr, -cy * sr - sy * sp * cr, -sy * cp], [sy * cr + cy * sp * sr, -sy * sr + cy * sp * cr, cy * cp], [-cp * sr, -cp * cr, sp]]


_M = _fixed_rotation()
_MOVED = [f"{SCALE} * ({' + '.join(f'({m!r}) * {k}' for m, k in zip(row, 'xyz'))}) + ({t!r})" for row, t in zip(_M, SHIFT)]
_AXIS = [" + ".join(f"({m!r}) * {k}" for m, k in zip(row, ("r02", "r12", "r22"))) for row in _M]
_COVS = {n: f"{SCALE * SCALE!r} * (({_M[i][0] * _M[j][0] + _M[i][1] * _M[j][1]!r}) * acc * acc + ({_M[i][2] * _M[j][2]!r}) * acc_v * acc_v)" for n, i, j in (("cxx", 0, 0), ("cyy", 1, 1), ("czz", 2, 2), ("cxy", 0, 1), ("cxz", 0, 2), ("cyz", 1, 2))}
# eigenvalues by the angle of the characteristic polynomial, as DuckDB has none of its own
_ELLIPSOIDS = """cov AS (SELECT flight_id, view, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM point GROUP BY ALL HAVING count(*) >= 3),
poly AS (SELECT *, (xx + yy + zz) / 3 AS q, sqrt(((xx - (xx + yy + zz) / 3) ** 2 + (yy - (xx + yy + zz) / 3) ** 2 + (zz - (xx + yy + zz) / 3) ** 2 + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM cov),
root AS (SELECT *, CASE WHEN p > 1e-12 THEN acos(greatest(-1.0, least(1.0, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p)))) / 3 END AS phi FROM poly),
value AS (SELECT *, coalesce(q + 2 * p * cos(phi), q) AS e1, coalesce(q + 2 * p * cos(phi + 2 * pi() / 3), q) AS e3 FROM root),
ell AS (SELECT *, sqrt(greatest(0.0, e1)) AS s1, sqrt(greatest(0.0, 3 * q - e1 - e3)) AS s2, sqrt(greatest(0.0, e3)) AS s3 FROM value)"""
_OFF = "abs(((degrees(atan2(-({y}), -({x}))) - own + 180) % 360 + 360) % 360 - 180)"
SQL = {
    "camera_rotations": f"WITH {_CAMERAS} SELECT flight_id, sample_id, {', '.join(f'{steady_sql(r, 6)} AS {r}' for r in R)}, {', '.join(f'{steady_sql(r, 6)} AS up_{k}' for r, k in zip(('r20', 'r21', 'r22'), 'xyz'))}, {', '.join(f'{steady_sql(r, 6)} AS ahead_{k}' for r, k in zip(('r02', 'r12', 'r22'), 'enu'))} FROM camera",
    "camera_turns": f"WITH {_CAMERAS}, {_BEFORE}, t AS (SELECT flight_id, sample_id, {steady_sql(_TURN, 3)} AS turn_deg, {steady_sql(_TILT, 3)} AS tilt_deg FROM before WHERE id_ IS NOT NULL) SELECT *, tilt_deg <= 3 AS gravity_kept FROM t",
    "landmark_projection": f"""WITH {_CAMERAS}, {_LANDMARKS}, off AS (SELECT c.*, lx - x AS ox, ly - y AS oy, lz - z AS oz FROM camera c JOIN landmark USING (flight_id, view)), seen AS (SELECT flight_id, sample_id, {', '.join(f'{e} AS s{k}' for e, k in zip(_turned('r', 'o'), 'xyz'))} FROM off),
flat AS (SELECT *, CASE WHEN sz > 1e-6 THEN sx / sz END AS fx, CASE WHEN sz > 1e-6 THEN sy / sz END AS fy FROM seen), r AS (SELECT *, fx * fx + fy * fy AS r2 FROM flat), l AS (SELECT *, 1 + r2 * ({LENS[0]} + r2 * ({LENS[1]} + r2 * {LENS[4]})) AS radial FROM r),
p AS (SELECT flight_id, sample_id, {steady_sql('sz', 3)} AS depth, CASE WHEN abs(fx) <= 2 AND abs(fy) <= 2 THEN {steady_sql(f'{FOCAL[0]} * (fx * radial + 2 * {LENS[2]} * fx * fy + ({LENS[3]}) * (r2 + 2 * fx * fx)) + {CENTRE[0]}', 2)} END AS u, CASE WHEN abs(fx) <= 2 AND abs(fy) <= 2 THEN {steady_sql(f'{FOCAL[1]} * (fy * radial + {LENS[2]} * (r2 + 2 * fy * fy) + 2 * ({LENS[3]}) * fx * fy) + {CENTRE[1]}', 2)} END AS v FROM l)
SELECT *, coalesce(u >= 0 AND u < {SIZE[0]} AND v >= 0 AND v < {SIZE[1]}, false) AS in_picture FROM p""",
    "similarity_poses": f"WITH {_CAMERAS} SELECT flight_id, sample_id, {', '.join(f'{steady_sql(e, 3)} AS {k}' for e, k in zip(_MOVED, 'xyz'))}, {', '.join(f'{steady_sql(e, 6)} AS axis_{k}' for e, k in zip(_AXIS, 'xyz'))}, {', '.join(f'{steady_sql(f'-{e}', 3)} AS back_{k}' for e, k in zip(['(' + ' + '.join(f'r{i}{j} * {a}' for i, a in enumerate('xyz')) + ')' for j in range(3)], 'xyz'))}, {', '.join(f'{steady_sql(e, 4)} AS {n}' for n, e in _COVS.items())}, {steady_sql(f'acc * {SCALE}', 4)} AS sigma FROM camera",
    "prior_sigmas": f"WITH {POINTS}, s AS (SELECT flight_id, sample_id, CASE WHEN acc IS NULL THEN 2.5 ELSE greatest(acc, 0.25) END AS h, acc_v FROM point) SELECT flight_id, sample_id, h AS sigma_e, h AS sigma_n, CASE WHEN acc_v IS NULL THEN h ELSE greatest(acc_v, 0.25) END AS sigma_u FROM s",
    "view_ellipsoids": f"WITH {POINTS}, {_ELLIPSOIDS}, r AS (SELECT flight_id, view, n, {', '.join(f'{steady_sql(s, 3)} AS {s}' for s in ('s1', 's2', 's3'))} FROM ell) SELECT *, CASE WHEN s3 > 0 THEN {steady_sql('s1 / s3', 4)} END AS anisotropy, CASE WHEN s1 <= 0.05 THEN 2 WHEN s1 <= 0.5 THEN 1 ELSE 0 END AS tier FROM r",
    "confidence_tiers": f"WITH {POINTS}, p AS (SELECT flight_id, sample_id, 1 / (1 + acc) AS raw, tier FROM point WHERE acc >= 0), done AS (SELECT coalesce(bool_and(raw IN (0, 1, 2)), true) AS d FROM p) SELECT flight_id, sample_id, CASE WHEN d THEN CAST(raw AS INTEGER) WHEN raw >= 0.8 THEN 2 WHEN raw >= 0.3 THEN 1 ELSE 0 END AS raw_tier, tier AS held_tier, CAST(round_even(least(greatest(round(raw, 6), 0.0), 1.0) * 255, 0) AS INTEGER) AS raw_byte FROM p, done",
    "flight_intrinsics": """WITH f AS (SELECT DISTINCT flight_id, log_kind, CASE lower(trim(airframe)) WHEN 'quad' THEN 78.0 WHEN 'fixed-wing' THEN 62.0 WHEN 'vtol' THEN 70.0 END AS fov FROM flights),
g AS (SELECT flight_id, CASE WHEN log_kind = 'srt' THEN 'user' WHEN fov IS NOT NULL THEN 'camera_db' ELSE 'default_guess' END AS source, CASE WHEN log_kind = 'srt' THEN 1500.0 ELSE 960 / tan(radians(coalesce(fov, 84.0)) / 2) END AS fx FROM f)
SELECT flight_id, source, round(fx, 6) AS fx, 960.0::DOUBLE AS cx, round(fx / 2, 6) AS half_fx, 480.0::DOUBLE AS half_cx, round(fx * 1.05, 6) AS corrected_fx FROM g""",
    "corrected_values": f"""WITH f AS (SELECT DISTINCT flight_id, frame_index, mean_luma, TRY_CAST(floor(t / 10) AS BIGINT) AS span FROM frames WHERE flight_id IS NOT NULL AND isfinite(t) AND mean_luma IS NOT NULL AND NOT isnan(mean_luma) AND t >= 0 AND t < 9e12),
g AS (SELECT flight_id, span, {steady_sql('greatest(0.4, least(2.5, 100 / avg(mean_luma)))', 6)} AS gain FROM f GROUP BY ALL) SELECT flight_id, frame_index, gain, {steady_sql('greatest(0.0, least(255.0, mean_luma * gain))', 4)} AS luma FROM f JOIN g USING (flight_id, span)""",
    "corrected_depths": f"WITH {POINTS} SELECT flight_id, sample_id, CASE WHEN alt_rel > 1e-6 THEN {steady_sql('1.02 * alt_rel + 0.5', 4)} ELSE 0.0 END AS depth FROM point WHERE alt_rel IS NOT NULL",
    "flow_headings": f"""WITH {_CAMERAS}, {_BEFORE}, way AS (SELECT *, x - x_ AS ox, y - y_ AS oy, 0.0 AS oz FROM before WHERE id_ IS NOT NULL AND (x - x_) ** 2 + (y - y_) ** 2 > 1),
own AS (SELECT *, degrees(atan2(-{_turned('r', 'o')[1]}, -{_turned('r', 'o')[0]})) AS own FROM way), h AS (SELECT flight_id, sample_id, ox, oy, b, c, own, h.heading, radians(-h.heading) AS a FROM own, (SELECT unnest(range(0, 360, 30)) AS heading) h),
m AS (SELECT *, (cos(a) * cos(c) - sin(a) * sin(b) * sin(c)) * ox + (sin(a) * cos(c) + cos(a) * sin(b) * sin(c)) * oy AS dx, (-cos(a) * sin(c) - sin(a) * sin(b) * cos(c)) * ox + (-sin(a) * sin(c) + cos(a) * sin(b) * cos(c)) * oy AS dy FROM h),
o AS (SELECT flight_id, sample_id, heading, {steady_sql(_OFF.format(x='dx', y='dy'), 3)} AS off FROM m) SELECT flight_id, sample_id, CAST(heading AS INTEGER) AS heading, off AS off_deg FROM o QUALIFY row_number() OVER (PARTITION BY flight_id, sample_id ORDER BY off, heading) = 1""",
    "frame_baselines": """WITH f AS (SELECT DISTINCT flight_id, frame_index, parallax, exposure_score, blur_score FROM frames WHERE flight_id IS NOT NULL AND parallax IS NOT NULL AND NOT isnan(parallax))
SELECT flight_id, frame_index, round(CASE WHEN parallax < 0.3 THEN 0.0 WHEN blur_score >= 100 THEN CASE WHEN exposure_score / 50 < 0.005 THEN 0.0 ELSE parallax END WHEN parallax < 2 THEN 0.0 WHEN parallax / 40 > 0.05 OR exposure_score < 0.5 THEN parallax ELSE 0.0 END, 6) AS useful_px FROM f""",
    "clock_gates": f"WITH {POINTS}, {_RUNS}, {_FRAMES}, v AS (SELECT flight_id, max(t_ms) AS video_ms FROM frame GROUP BY ALL), fit AS (SELECT v.flight_id, abs(end_ms - start_ms - video_ms) <= greatest(2000.0, video_ms * 0.01) AS fits FROM v LEFT JOIN run USING (flight_id)), s AS (SELECT flight_id, count(*) FILTER (fits) <> 1 AS assumed FROM fit GROUP BY ALL), d AS (SELECT flight_id, arg_min(alt_msl, t_ms) AS datum_m FROM point GROUP BY ALL) SELECT f.flight_id, round(CASE WHEN log_kind = 'srt' THEN 1 / 30 ELSE 0.1 END, 6) AS sigma_s, datum_m, coalesce(log_kind IN ('csv', 'gpx') AND assumed, false) AS refused FROM (SELECT DISTINCT flight_id, log_kind FROM flights) f LEFT JOIN d USING (flight_id) LEFT JOIN s USING (flight_id)",
    "reconstruction_ready": f"""WITH {_CAMERAS}, q AS (SELECT flight_id AS f, x FROM ({SEQUENCE_SQL['resample_interpolate']})), n AS (SELECT f AS flight_id, count(*) AS frames, count(x) AS placed FROM q GROUP BY ALL), m AS (SELECT flight_id, quantile_cont(round(degrees(acos(greatest(-1.0, least(1.0, -r22)))) * 1000), 0.5) AS tilt, quantile_cont(round(pitch * 1000), 0.5) AS p FROM camera GROUP BY ALL)
SELECT flight_id, frames, placed, placed >= 3 AND placed >= 0.7 * frames AS surface_ready, placed >= 3 AND placed >= 0.7 * frames AND coalesce(tilt <= 20000, false) AS heights_ready, coalesce(abs(p + 90000) > 30000, false) AS not_nadir FROM n LEFT JOIN m USING (flight_id)""",
    "camera_validation": f"""WITH {_CAMERAS}, {_BEFORE}, c AS (SELECT *, (x_ + x + nx) / 3 AS mx, (y_ + y + ny) / 3 AS my, (z_ + z + nz) / 3 AS mz FROM before WHERE id_ IS NOT NULL AND nid IS NOT NULL),
s AS (SELECT flight_id, round(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) * 1000) AS shift, round({_TURN} * 1000) AS turn FROM c), v AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY flight_id, view ORDER BY t_ms) = 1),
b AS (SELECT a.flight_id, sqrt((a.x - e.x) ** 2 + (a.y - e.y) ** 2 + (a.z - e.z) ** 2) AS raw, sqrt((a.mx - e.mx) ** 2 + (a.my - e.my) ** 2 + (a.mz - e.mz) ** 2) AS mid FROM v a JOIN v e ON e.flight_id = a.flight_id AND e.view = a.view - 1),
k AS (SELECT flight_id, quantile_cont(round(mid / raw * 10000), 0.5) AS scale FROM b WHERE raw >= 10 GROUP BY ALL), g AS (SELECT flight_id, quantile_cont(shift, 0.5) / 1000 AS median_shift, max(shift) / 1000 AS max_shift, quantile_cont(turn, 0.5) / 1000 AS median_turn, max(turn) / 1000 AS max_turn FROM s GROUP BY ALL)
SELECT g.*, scale / 10000 AS scale, concat_ws(', ', CASE WHEN median_shift > 15 THEN 'median shift' END, CASE WHEN max_shift > 30 THEN 'max shift' END, CASE WHEN median_turn > 15 THEN 'median turn' END, CASE WHEN max_turn > 30 THEN 'max turn' END, CASE WHEN scale < 8000 OR scale > 12500 THEN 'baseline scale' END) AS failures FROM g LEFT JOIN k USING (flight_id)""",
    "text_values": """WITH r AS (SELECT DISTINCT reading_id, trim(accuracy_h) AS h, trim(accuracy_v) AS v, note, accuracy_v, received_at FROM accuracy_readings)
SELECT reading_id, max(TRY_CAST(h AS DOUBLE)) AS number, max(round(TRY_CAST(h AS DOUBLE) / nullif(TRY_CAST(v AS DOUBLE), 0), 6)) AS ratio, bool_or(lower(trim(coalesce(note, CASE WHEN accuracy_v = '12 sats' THEN 'yes' END))) IN ('1', 'true', 'yes', 'y')) AS flagged, max(epoch_us(received_at) / 1000000) AS received_s FROM r GROUP BY reading_id""",
}
# SQL of viewing_needs would need eigenvectors; a test holds it against numpy
QUERIES = {name: globals()[name] for name in (*SQL, "viewing_needs")}
