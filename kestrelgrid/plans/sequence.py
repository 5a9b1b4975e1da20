"""Sequence queries: gaps and islands, interpolation, derivatives and headings along each flight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import millis
from kestrelgrid.functions.geodesy import wrap_degrees
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.split_windows import carried, haloed, neighbours, numbered, running
from kestrelgrid.plans.points import BUCKET_MS, CLOCK_MS, POINTS, SERIES, points, series
from kestrelgrid.sources.tables import table

BY, ORDER = ["flight_id"], ["t_ms"]


def recording_segments(spark: SparkSession, d: str) -> DataFrame:
    """Maximal runs of recording rows; a run ends at its last row, not where the flag falls."""
    flagged = neighbours(series(spark, d).where("is_video IS NOT NULL"), BY, ORDER, "bucket", ["is_video"])
    starts = F.when(F.col("is_video") & ~F.coalesce("prev.is_video", F.lit(False)), 1)
    runs = running(flagged.withColumn("starts", starts), BY, ORDER, "bucket", {"run": F.col("starts")})
    return runs.where("is_video").groupBy("flight_id", F.col("run").cast("bigint").alias("run")).agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count("*").alias("n"))


def frame_times(spark: SparkSession, d: str) -> DataFrame:
    """(flight_id, frame_index, t_ms, bucket), repeated rows once."""
    f = table(spark, d, "frames").where("flight_id IS NOT NULL").select("flight_id", "frame_index", millis(F.col("t")).alias("t_ms"))
    one = f.where("t_ms IS NOT NULL").groupBy("flight_id", "frame_index").agg(F.min("t_ms").alias("t_ms"))
    return one.withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint"))


def interpolated(samples: DataFrame, asked: DataFrame, values: list[str]) -> DataFrame:
    """asked: (flight_id, q, t_ms, bucket) with the samples before and after each time: structs ``a`` and ``b``."""
    row = F.struct("t_ms", *values)
    both = samples.select("flight_id", "t_ms", "bucket", F.lit(None).cast(dict(asked.dtypes)["q"]).alias("q"), row.alias("s")).unionByName(asked.select("flight_id", "t_ms", "bucket", "q", F.lit(None).alias("s")))
    is_asked = F.col("q").isNotNull()
    up = carried(both, BY, [F.col("t_ms"), is_asked], "bucket", {"a": F.col("s")})
    down = carried(up, BY, [F.desc("t_ms"), is_asked], "bucket", {"b": F.col("s")}, forward=False)
    return down.where(is_asked).select("flight_id", "q", "t_ms", "a", "b")


def _between(name: str) -> F.Column:
    """Linear between a and b; NULL outside the samples' range."""
    a, b, t = F.col(f"a.{name}"), F.col(f"b.{name}"), F.col("t_ms")
    return F.when(F.col("a.t_ms") == F.col("b.t_ms"), a).otherwise(a + (b - a) * (t - F.col("a.t_ms")) / (F.col("b.t_ms") - F.col("a.t_ms")))


def resample_interpolate(spark: SparkSession, d: str) -> DataFrame:
    """Position at each frame's time, linear between fixes, never beyond them; accuracy is that of the worse neighbour."""
    found = interpolated(points(spark, d), frame_times(spark, d).withColumnRenamed("frame_index", "q"), ["x", "y", "z", "acc"])
    worst = F.when(F.col("a.acc").isNotNull() & F.col("b.acc").isNotNull(), F.greatest("a.acc", "b.acc"))
    return found.select("flight_id", F.col("q").alias("frame_index"), *[steady(_between(c), 4).alias(c) for c in "xyz"], F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), worst).alias("acc"))


def asof_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last fix at or before each frame."""
    found = interpolated(points(spark, d), frame_times(spark, d).withColumnRenamed("frame_index", "q"), ["sample_id"])
    return found.select("flight_id", F.col("q").alias("frame_index"), F.col("a.sample_id").alias("sample_id"), (F.col("t_ms") - F.col("a.t_ms")).alias("age_ms"))


def ground_speed_central(spark: SparkSession, d: str) -> DataFrame:
    """Horizontal speed by central differences, one-sided at the ends, 0 where time does not advance."""
    p = neighbours(points(spark, d), BY, ORDER, "bucket", ["x", "y"])
    a = {c: F.coalesce(f"prev.{c}", c) for c in ("t_ms", "x", "y")}
    b = {c: F.coalesce(f"next.{c}", c) for c in ("t_ms", "x", "y")}
    dt = (b["t_ms"] - a["t_ms"]) / 1000
    speed = F.when(dt > 0, F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)) / dt).otherwise(0.0)
    return p.select("flight_id", "t_ms", F.round(speed, 4).alias("speed"))


def trajectory_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of each flight's path in space."""
    p = neighbours(points(spark, d), BY, ORDER, "bucket", ["x", "y", "z"])
    step = F.sqrt(sum((F.pow(F.col(c) - F.col(f"prev.{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return p.groupBy("flight_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(step), F.lit(0.0)), 3).alias("length_m"))


def moves(spark: SparkSession, d: str) -> DataFrame:
    """Steps faster than 2 m/s and their course in degrees, clockwise from north."""
    p = neighbours(points(spark, d), BY, ORDER, "bucket", ["x", "y"])
    dx, dy, dt = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y"), (F.col("t_ms") - F.col("prev.t_ms")) / 1000
    return p.where(F.sqrt(dx * dx + dy * dy) > 2 * dt).select("flight_id", "t_ms", "bucket", F.degrees(F.atan2(dx, dy)).alias("course"))


def heading_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Courses without the jumps of a full turn."""
    h = neighbours(moves(spark, d), BY, ORDER, "bucket", ["course"])
    turns = F.floor((F.col("course") - F.col("prev.course")) / 360 + 0.5)
    total = running(h.select("flight_id", "t_ms", "bucket", "course", turns.alias("turns")), BY, ORDER, "bucket", {"full": F.col("turns")})
    return total.select("flight_id", "t_ms", F.round(F.col("course") - 360 * F.col("full"), 4).alias("heading"))


def turn_rate(spark: SparkSession, d: str) -> DataFrame:
    """Change of course between the second before and the second after each fix; NULL where less than 2 m was flown in either."""
    p = points(spark, d).select("flight_id", "t_ms", "bucket", "x", "y")
    asked = p.select("flight_id", F.col("t_ms").alias("at"), F.explode(F.array(F.lit(-1000), F.lit(0), F.lit(1000))).alias("k"))
    asked = asked.select("flight_id", F.struct("at", "k").alias("q"), (F.col("at") + F.col("k")).alias("t_ms")).withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint"))
    at = interpolated(p, asked, ["x", "y"]).select("flight_id", "q.at", "q.k", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct(_between("x").alias("x"), _between("y").alias("y"))).alias("p"))
    r = at.groupBy("flight_id", "at").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(n) for k, n in ((-1000, "u"), (0, "v"), (1000, "w"))])
    gone, left = [(F.col(f"{b}.x") - F.col(f"{a}.x"), F.col(f"{b}.y") - F.col(f"{a}.y")) for a, b in (("u", "v"), ("v", "w"))]
    far = [F.sqrt(x * x + y * y) for x, y in (gone, left)]
    turn = wrap_degrees(F.degrees(F.atan2(left[0], left[1])) - F.degrees(F.atan2(gone[0], gone[1])))
    return r.select("flight_id", F.col("at").alias("t_ms"), steady(F.when((far[0] >= 2) & (far[1] >= 2), turn), 3).alias("deg_per_s"))


def course_yaw(spark: SparkSession, d: str) -> DataFrame:
    """Yaw across each fix's neighbours where at least 1 m was flown; else that of the fix nearest in order, the earlier of two."""
    p = numbered(points(spark, d), BY, ORDER, "bucket")
    p = neighbours(p, BY, ORDER, "bucket", ["x", "y"])
    dx = F.coalesce("next.x", "x") - F.coalesce("prev.x", "x")
    dy = F.coalesce("next.y", "y") - F.coalesce("prev.y", "y")
    yaw = F.when(dx * dx + dy * dy >= 1, steady(F.degrees(F.atan2(0 - dx, dy)), 6))
    own = p.select("flight_id", "t_ms", "bucket", "i", yaw.alias("own")).withColumn("c", F.when(F.col("own").isNotNull(), F.struct("i", "own")))
    up = carried(own, BY, [F.col("t_ms")], "bucket", {"a": F.col("c")})
    down = carried(up, BY, [F.desc("t_ms")], "bucket", {"b": F.col("c")}, forward=False)
    nearer = F.when(F.col("b.i") - F.col("i") < F.col("i") - F.col("a.i"), F.col("b.own")).otherwise(F.coalesce("a.own", "b.own"))
    return down.select("flight_id", "t_ms", nearer.alias("yaw"))


def frame_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Frames numbered by time, with their scores."""
    f = table(spark, d, "frames").where("flight_id IS NOT NULL").withColumn("t_ms", millis(F.col("t"))).where("t_ms IS NOT NULL")
    one = f.groupBy("flight_id", "frame_index").agg(F.min(F.struct("t_ms", "blur_score", "parallax")).alias("r")).select("flight_id", "frame_index", "r.*")
    return numbered(one.withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint")), BY, ["t_ms", "frame_index"], "bucket").drop("bucket")


def running_median5(spark: SparkSession, d: str) -> DataFrame:
    """Median parallax over two frames to either side."""
    f = haloed(frame_sequence(spark, d), BY, "i", 2)
    w = Window.partitionBy("flight_id", "run").orderBy("i").rowsBetween(-2, 2)
    return f.withColumn("m", F.percentile("parallax", F.lit(0.5)).over(w)).where("own").select("flight_id", "frame_index", F.round("m", 6).alias("parallax"))


def sharpest_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Of three frames to either side the sharpest, the earliest of equals."""
    f = haloed(frame_sequence(spark, d), BY, "i", 3)
    w = Window.partitionBy("flight_id", "run").orderBy("i").rowsBetween(-3, 3)
    best = F.max(F.when(F.col("blur_score").isNotNull() & ~F.isnan("blur_score"), F.struct("blur_score", (-F.col("i")).alias("k"), "frame_index"))).over(w)
    return f.withColumn("best", best).where("own").select("flight_id", "frame_index", F.col("best.frame_index").alias("sharpest"))


def blur_floor(spark: SparkSession, d: str) -> DataFrame:
    """Half the median sharpness of up to 15 frames before, once there are five, 20 at least."""
    f = haloed(frame_sequence(spark, d).where("blur_score IS NOT NULL AND NOT isnan(blur_score)").drop("i").withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint")).transform(lambda x: numbered(x, BY, ["t_ms", "frame_index"], "bucket")), BY, "i", 15)
    w = Window.partitionBy("flight_id", "run").orderBy("i").rowsBetween(-15, -1)
    f = f.withColumns({"m": F.percentile("blur_score", F.lit(0.5)).over(w), "n": F.count("*").over(w)})
    return f.where("own").select("flight_id", "frame_index", F.round(F.when(F.col("n") >= 5, F.greatest(F.lit(20.0), F.col("m") * 0.5)).otherwise(20.0), 6).alias("floor"))


def keyframe_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the next and the one after, if later by at most 6 s."""
    f = haloed(frame_sequence(spark, d), BY, "i", 2)
    w = Window.partitionBy("flight_id", "run").orderBy("i")
    pairs = F.array(*[F.struct(F.lit(k).alias("step"), F.lead("frame_index", k).over(w).alias("b"), F.lead("t_ms", k).over(w).alias("tb")) for k in (1, 2)])
    p = f.withColumn("p", pairs).where("own").select("flight_id", F.col("frame_index").alias("a"), "t_ms", F.explode("p").alias("p"))
    return p.where((F.col("p.tb") > F.col("t_ms")) & (F.col("p.tb") - F.col("t_ms") <= 6000)).select("flight_id", "p.step", "a", "p.b")


def path_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Extent, length and spacing of each flight's path; spacings in whole centimetres, those of 0 left out."""
    p = neighbours(points(spark, d), BY, ORDER, "bucket", ["x", "y"])
    step = F.sqrt(F.pow(F.col("x") - F.col("prev.x"), 2) + F.pow(F.col("y") - F.col("prev.y"), 2))
    p = p.withColumns({"step": step, "cm": F.round(step * 100).cast("bigint")})
    whole = p.groupBy("flight_id").agg(F.round(F.max("x") - F.min("x"), 3).alias("extent_e"), F.round(F.max("y") - F.min("y"), 3).alias("extent_n"), F.round(F.sum("step"), 3).alias("length_m"), F.round(F.min("z"), 3).alias("z_min"), F.round(F.max("z"), 3).alias("z_max"))
    counts = p.where("cm > 0").groupBy("flight_id", "cm").agg(F.count("*").alias("n"))  # what a percentile holds is bounded by the spacings that differ
    q = lambda x: F.percentile("cm", F.lit(x), F.col("n"))
    spacing = counts.groupBy("flight_id").agg(F.min("cm").alias("cm_min"), F.max("cm").alias("cm_max"), F.round(q(0.5), 4).alias("cm_median"), F.round(q(0.95) / q(0.05), 4).alias("spread"))
    return whole.join(spacing, "flight_id", "left")


def circular_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean direction of the gimbal in each flight."""
    r = F.radians("gimbal_yaw")
    m = series(spark, d).where("gimbal_yaw IS NOT NULL AND NOT isnan(gimbal_yaw)").groupBy("flight_id").agg(F.avg(F.sin(r)).alias("s"), F.avg(F.cos(r)).alias("c"))
    return m.select("flight_id", F.round(F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)), 4).alias("mean_yaw"))


def flight_profile(spark: SparkSession, d: str) -> DataFrame:
    """Median and spread of pitch and height, and the gimbal's mode, of each flight; pitch in tenths of a degree, height in dm."""
    s = series(spark, d).select("flight_id", F.round(F.col("gimbal_pitch") * 10).cast("bigint").alias("pitch"), F.round(F.coalesce("geo.alt_rel", "geo.alt_msl") * 10).cast("bigint").alias("height"))
    flights = table(spark, d, "flights").select("flight_id").distinct()
    out = flights
    for c in ("pitch", "height"):
        n = s.where(F.col(c).isNotNull()).groupBy("flight_id", c).agg(F.count("*").alias("n"))
        mean = F.sum(F.col(c) * F.col("n")) / F.sum("n")
        stats = n.groupBy("flight_id").agg(F.round(F.percentile(c, F.lit(0.5), F.col("n")) / 10, 4).alias(f"{c}_median"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col(c) * F.col(c) * F.col("n")) / F.sum("n") - mean * mean)) / 10, 3).alias(f"{c}_sd"))
        out = out.join(stats, "flight_id", "left")
    p, sd = F.col("pitch_median"), F.col("pitch_sd")
    mode = F.when(p.isNull() | (sd > 15), "varying").when(F.abs(p + 90) <= 20, "nadir").when(F.abs(p) <= 20, "forward").otherwise("oblique")
    return out.withColumn("gimbal_mode", mode)


def gps_grade(spark: SparkSession, d: str) -> DataFrame:
    """RTK where the median horizontal accuracy is at most 0.10 m, UNKNOWN where none is stated; in whole millimetres."""
    n = points(spark, d).where("acc > 0").groupBy("flight_id", F.round(F.col("acc") * 1000).cast("bigint").alias("mm")).agg(F.count("*").alias("n"))
    m = n.groupBy("flight_id").agg((F.percentile("mm", F.lit(0.5), F.col("n")) / 1000).alias("m"))
    f = table(spark, d, "flights").select("flight_id").distinct().join(m, "flight_id", "left")
    return f.select("flight_id", F.round("m", 5).alias("median_acc"), F.when(F.col("m").isNull(), "UNKNOWN").when(F.col("m") <= 0.10, "RTK").otherwise("STANDALONE").alias("grade"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 frames that share 30 with the one before; the last is cut short."""
    n = frame_sequence(spark, d).groupBy("flight_id").agg(F.count("*").alias("n"))
    k = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil((F.col("n") - 100) / 70)).cast("bigint"))
    w = n.withColumn("w", F.explode(k))
    return w.select("flight_id", "w", (F.col("w") * 70).alias("first"), F.least(F.col("w") * 70 + 100, "n").alias("past"), F.when(F.col("w") > 0, 30).otherwise(0).cast("bigint").alias("shared"))


def view_owner(spark: SparkSession, d: str) -> DataFrame:
    """The window in which each frame lies deepest, the earlier of equals."""
    f = frame_sequence(spark, d)
    n = f.groupBy("flight_id").agg(F.count("*").alias("n"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - 100) / 70)).cast("bigint")
    c = f.join(n, "flight_id").withColumn("last", last)
    c = c.withColumn("w", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - 30) / 70)).cast("bigint"), F.least(F.col("last"), F.floor(F.col("i") / 70).cast("bigint")))))
    c = c.where((F.col("i") >= F.col("w") * 70) & (F.col("i") < F.least(F.col("w") * 70 + 100, "n")))
    depth = F.least(F.col("i") - F.col("w") * 70, F.least(F.col("w") * 70 + 100, "n") - 1 - F.col("i"))
    return c.groupBy("flight_id", "frame_index").agg(F.max(F.struct(depth.alias("depth"), (-F.col("w")).alias("k"))).alias("b")).select("flight_id", "frame_index", (-F.col("b.k")).alias("owner"))


def segment_offset(spark: SparkSession, d: str) -> DataFrame:
    """Where the video starts on the log's clock: at the only recorded run about as long as the video, else assumed 0."""
    runs = recording_segments(spark, d).withColumn("ms", F.col("end_ms") - F.col("start_ms"))
    video = frame_times(spark, d).groupBy("flight_id").agg(F.max("t_ms").alias("video_ms"))
    fit = video.join(runs, "flight_id", "left").withColumn("fits", F.abs(F.col("ms") - F.col("video_ms")) <= F.greatest(F.lit(2000.0), F.col("video_ms") * 0.01))
    r = fit.groupBy("flight_id").agg(F.count_if("fits").alias("n"), F.min(F.when(F.col("fits"), F.col("start_ms"))).alias("at"))
    return r.select("flight_id", F.when(F.col("n") == 1, F.col("at")).otherwise(0).alias("offset_ms"), F.when(F.col("n") == 1, "recording_segment").otherwise("assumed_zero").alias("source"))


_FRAMES = f"""frame AS (
  SELECT flight_id, frame_index, min(CAST(floor(t * 1000 + 0.5) AS BIGINT)) AS t_ms, arg_min(blur_score, (t, blur_score, parallax)) AS blur_score, arg_min(parallax, (t, blur_score, parallax)) AS parallax
  FROM frames WHERE flight_id IS NOT NULL AND isfinite(t) AND abs(floor(t * 1000 + 0.5)) < {CLOCK_MS} GROUP BY ALL
), numbered AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t_ms, frame_index) - 1 AS i FROM frame)"""
_RUNS = """run AS (
  SELECT flight_id, run, min(t_ms) AS start_ms, max(t_ms) AS end_ms, count(*) AS n FROM (
    SELECT *, CAST(sum(CASE WHEN is_video AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY t_ms) AS BIGINT) AS run
    FROM (SELECT *, lag(is_video) OVER (PARTITION BY flight_id ORDER BY t_ms) AS before FROM series WHERE is_video IS NOT NULL)
  ) WHERE is_video GROUP BY ALL
)"""
_MOVES = """step AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, (t_ms - lag(t_ms) OVER w) / 1000 AS dt FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)),
move AS (SELECT flight_id, t_ms, degrees(atan2(dx, dy)) AS course FROM step WHERE sqrt(dx * dx + dy * dy) > 2 * dt)"""
_AT = """SELECT q.*, a.t_ms AS ta, a.x AS xa, a.y AS ya, a.z AS za, a.acc AS acca, a.sample_id AS ida, b.t_ms AS tb, b.x AS xb, b.y AS yb, b.z AS zb, b.acc AS accb
  FROM {asked} q ASOF LEFT JOIN point a ON a.flight_id = q.flight_id AND a.t_ms <= q.t_ms ASOF LEFT JOIN point b ON b.flight_id = q.flight_id AND b.t_ms >= q.t_ms"""
_LINE = "CASE WHEN ta = tb THEN {c}a ELSE {c}a + ({c}b - {c}a) * (t_ms - ta) / (tb - ta) END"

SQL = {
    "recording_segments": f"WITH {SERIES}, {_RUNS} SELECT * FROM run",
    "resample_interpolate": f"WITH {POINTS}, {_FRAMES}, bracket AS ({_AT.format(asked='frame')}) SELECT flight_id, frame_index, " + ", ".join(f"{steady_sql(_LINE.format(c=c), 4)} AS {c}" for c in "xyz") + ", CASE WHEN ta IS NOT NULL AND tb IS NOT NULL AND acca IS NOT NULL AND accb IS NOT NULL THEN greatest(acca, accb) END AS acc FROM bracket",
    "asof_latest": f"WITH {POINTS}, {_FRAMES}, bracket AS ({_AT.format(asked='frame')}) SELECT flight_id, frame_index, ida AS sample_id, t_ms - ta AS age_ms FROM bracket",
    "ground_speed_central": f"""WITH {POINTS}, n AS (SELECT *, coalesce(lag(t_ms) OVER w, t_ms) AS t1, coalesce(lag(x) OVER w, x) AS x1, coalesce(lag(y) OVER w, y) AS y1, coalesce(lead(t_ms) OVER w, t_ms) AS t2, coalesce(lead(x) OVER w, x) AS x2, coalesce(lead(y) OVER w, y) AS y2 FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms))
SELECT flight_id, t_ms, round(CASE WHEN t2 > t1 THEN sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / ((t2 - t1) / 1000) ELSE 0.0 END, 4) AS speed FROM n""",
    "trajectory_length": f"""WITH {POINTS} SELECT flight_id, count(*) AS n, round(coalesce(sum(s), 0.0), 3) AS length_m FROM (SELECT flight_id, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS s FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)) GROUP BY flight_id""",
    "heading_unwrap": f"""WITH {POINTS}, {_MOVES} SELECT flight_id, t_ms, round(course - 360 * coalesce(sum(turns) OVER (PARTITION BY flight_id ORDER BY t_ms), 0), 4) AS heading
FROM (SELECT *, floor((course - lag(course) OVER (PARTITION BY flight_id ORDER BY t_ms)) / 360 + 0.5) AS turns FROM move)""",
    "turn_rate": f"""WITH {POINTS}, asked AS (SELECT flight_id, t_ms AS mid, k, t_ms + k AS t_ms FROM point, (VALUES (-1000), (0), (1000)) v(k)), bracket AS ({_AT.format(asked='asked')}),
p AS (SELECT flight_id, mid, {', '.join(f"max(CASE WHEN k = {k} AND ta IS NOT NULL AND tb IS NOT NULL THEN {_LINE.format(c=c)} END) AS {c}{n}" for n, k in enumerate((-1000, 0, 1000)) for c in 'xy')} FROM bracket GROUP BY ALL)
SELECT flight_id, mid AS t_ms, floor((CASE WHEN sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 2 AND sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) >= 2
  THEN ((degrees(atan2(x2 - x1, y2 - y1)) - degrees(atan2(x1 - x0, y1 - y0)) + 180) % 360 + 360) % 360 - 180 END) * 1000 + 0.500001) / 1000 AS deg_per_s FROM p""",
    "course_yaw": f"""WITH {POINTS}, n AS (SELECT flight_id, t_ms, row_number() OVER w - 1 AS i, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)),
o AS (SELECT *, CASE WHEN dx * dx + dy * dy >= 1 THEN floor(degrees(atan2(0.0 - dx, dy)) * 1000000 + 0.500001) / 1000000 END AS own FROM n), c AS (SELECT *, CASE WHEN own IS NOT NULL THEN i END AS k FROM o),
near AS (SELECT *, last_value(k IGNORE NULLS) OVER u AS ia, last_value(own IGNORE NULLS) OVER u AS a, first_value(k IGNORE NULLS) OVER v AS ib, first_value(own IGNORE NULLS) OVER v AS b FROM c
  WINDOW u AS (PARTITION BY flight_id ORDER BY t_ms ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY flight_id ORDER BY t_ms ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT flight_id, t_ms, CASE WHEN ib - i < i - ia THEN b ELSE coalesce(a, b) END AS yaw FROM near""",
    "running_median5": f"WITH {_FRAMES} SELECT flight_id, frame_index, round(quantile_cont(parallax, 0.5) OVER (PARTITION BY flight_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS parallax FROM numbered",
    "sharpest_in_window": f"""WITH {_FRAMES}, n AS (SELECT a.flight_id, a.frame_index, b.frame_index AS sharpest, row_number() OVER (PARTITION BY a.flight_id, a.frame_index ORDER BY b.blur_score DESC, b.i) AS r
FROM numbered a LEFT JOIN numbered b ON b.flight_id = a.flight_id AND b.i BETWEEN a.i - 3 AND a.i + 3 AND b.blur_score IS NOT NULL AND NOT isnan(b.blur_score)) SELECT flight_id, frame_index, sharpest FROM n WHERE r = 1""",
    "blur_floor": f"""WITH {_FRAMES}, n AS (SELECT flight_id, frame_index, quantile_cont(blur_score, 0.5) OVER w AS m, count(*) OVER w AS n FROM (SELECT * FROM numbered WHERE blur_score IS NOT NULL AND NOT isnan(blur_score)) WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms, frame_index ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING))
SELECT flight_id, frame_index, round(CASE WHEN n >= 5 THEN greatest(20.0, m * 0.5) ELSE 20.0 END, 6) AS floor FROM n""",
    "keyframe_pairs": f"""WITH {_FRAMES} SELECT a.flight_id, CAST(b.i - a.i AS INTEGER) AS step, a.frame_index AS a, b.frame_index AS b FROM numbered a JOIN numbered b ON b.flight_id = a.flight_id AND b.i IN (a.i + 1, a.i + 2) WHERE b.t_ms > a.t_ms AND b.t_ms - a.t_ms <= 6000""",
    "path_metrics": f"""WITH {POINTS}, s AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS step FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)), c AS (SELECT *, round(step * 100) AS cm FROM s)
SELECT flight_id, round(max(x) - min(x), 3) AS extent_e, round(max(y) - min(y), 3) AS extent_n, round(sum(step), 3) AS length_m, round(min(z), 3) AS z_min, round(max(z), 3) AS z_max,
  CAST(min(cm) FILTER (cm > 0) AS BIGINT) AS cm_min, CAST(max(cm) FILTER (cm > 0) AS BIGINT) AS cm_max, round(quantile_cont(cm, 0.5) FILTER (cm > 0), 4) AS cm_median, round(quantile_cont(cm, 0.95) FILTER (cm > 0) / quantile_cont(cm, 0.05) FILTER (cm > 0), 4) AS spread FROM c GROUP BY flight_id""",
    "circular_mean": f"WITH {SERIES} SELECT flight_id, round((degrees(atan2(avg(sin(radians(gimbal_yaw))), avg(cos(radians(gimbal_yaw))))) % 360 + 360) % 360, 4) AS mean_yaw FROM series WHERE gimbal_yaw IS NOT NULL AND NOT isnan(gimbal_yaw) GROUP BY flight_id",
    "flight_profile": f"""WITH {SERIES}, s AS (SELECT flight_id, round(gimbal_pitch * 10) AS pitch, round(coalesce(geo.alt_rel, geo.alt_msl) * 10) AS height FROM series),
m AS (SELECT flight_id, round(quantile_cont(pitch, 0.5) / 10, 4) AS pitch_median, round(stddev_pop(pitch) / 10, 3) AS pitch_sd, round(quantile_cont(height, 0.5) / 10, 4) AS height_median, round(stddev_pop(height) / 10, 3) AS height_sd FROM s GROUP BY flight_id)
SELECT f.flight_id, pitch_median, pitch_sd, height_median, height_sd, CASE WHEN pitch_median IS NULL OR pitch_sd > 15 THEN 'varying' WHEN abs(pitch_median + 90) <= 20 THEN 'nadir' WHEN abs(pitch_median) <= 20 THEN 'forward' ELSE 'oblique' END AS gimbal_mode
FROM (SELECT DISTINCT flight_id FROM flights) f LEFT JOIN m USING (flight_id)""",
    "gps_grade": f"""WITH {POINTS}, m AS (SELECT flight_id, quantile_cont(round(acc * 1000), 0.5) / 1000 AS m FROM point WHERE acc > 0 GROUP BY flight_id)
SELECT f.flight_id, round(m, 5) AS median_acc, CASE WHEN m IS NULL THEN 'UNKNOWN' WHEN m <= 0.10 THEN 'RTK' ELSE 'STANDALONE' END AS grade FROM (SELECT DISTINCT flight_id FROM flights) f LEFT JOIN m USING (flight_id)""",
    "sliding_windows": f"""WITH {_FRAMES}, n AS (SELECT flight_id, count(*) AS n FROM numbered GROUP BY ALL), w AS (SELECT flight_id, n, unnest(range(CAST(greatest(0, ceil((n - 100) / 70)) AS BIGINT) + 1)) AS w FROM n)
SELECT flight_id, w, w * 70 AS first, least(w * 70 + 100, n) AS past, CAST(CASE WHEN w > 0 THEN 30 ELSE 0 END AS BIGINT) AS shared FROM w""",
    "view_owner": f"""WITH {_FRAMES}, n AS (SELECT flight_id, count(*) AS n FROM numbered GROUP BY ALL), w AS (SELECT flight_id, n, unnest(range(CAST(greatest(0, ceil((n - 100) / 70)) AS BIGINT) + 1)) AS w FROM n), c AS (SELECT f.flight_id, frame_index, w, least(i - w * 70, least(w * 70 + 100, n) - 1 - i) AS depth FROM numbered f JOIN w ON w.flight_id = f.flight_id AND i >= w * 70 AND i < least(w * 70 + 100, n))
SELECT flight_id, frame_index, w AS owner FROM c QUALIFY row_number() OVER (PARTITION BY flight_id, frame_index ORDER BY depth DESC, w) = 1""",
    "segment_offset": f"""WITH {SERIES}, {_RUNS}, {_FRAMES}, v AS (SELECT flight_id, max(t_ms) AS video_ms FROM frame GROUP BY ALL), fit AS (SELECT v.flight_id, start_ms, abs(end_ms - start_ms - video_ms) <= greatest(2000.0, video_ms * 0.01) AS fits FROM v LEFT JOIN run USING (flight_id))
SELECT flight_id, CASE WHEN count(*) FILTER (fits) = 1 THEN min(start_ms) FILTER (fits) ELSE 0 END AS offset_ms, CASE WHEN count(*) FILTER (fits) = 1 THEN 'recording_segment' ELSE 'assumed_zero' END AS source FROM fit GROUP BY flight_id""",
}
QUERIES = {name: globals()[name] for name in SQL}
