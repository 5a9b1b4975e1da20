"""Robust estimates, fits, gates and reports; and relational extensions (grouping sets, sessions, set operations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.geodesy import enu, utm_epsg, with_geodetic, wrap_degrees
from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.grid import counted_median
from kestrelgrid.operators.split_windows import carried, neighbours
from kestrelgrid.plans.points import BUCKET_MS, POINTS, SERIES, points, series
from kestrelgrid.plans.sequence import _FRAMES, _MOVES, frame_sequence, moves
from kestrelgrid.plans.surface import _GROUND, ground_z
from kestrelgrid.sources.tables import table

BY = ["flight_id"]


def clock_lag_search(spark: SparkSession, d: str) -> DataFrame:
    """Lag, of -5 to 5 whole seconds, at which changes of the gimbal's heading best follow changes of the course.

    Residuals are wrapped, cut off at 20 degrees and squared; of equal costs the lag nearest 0, then the smaller.
    """
    m = moves(spark, d).select("flight_id", F.col("t_ms").alias("at"), "course")
    lags = F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("lag")
    asked = m.select("flight_id", "at", "course", lags).select("flight_id", (F.col("at") + F.col("lag") * 1000).alias("t_ms"), F.struct("lag", "at", "course").alias("q"), F.lit(None).cast("double").alias("yaw"))
    known = series(spark, d).where("gimbal_yaw IS NOT NULL AND NOT isnan(gimbal_yaw)").select("flight_id", "t_ms", F.lit(None).cast(asked.schema["q"].dataType).alias("q"), F.col("gimbal_yaw").alias("yaw"))
    both = known.unionByName(asked).withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint"))
    at = carried(both, BY, [F.col("t_ms"), F.col("q").isNotNull(), F.col("q")], "bucket", {"held": F.col("yaw")}).where("q IS NOT NULL AND held IS NOT NULL")
    rows = at.select("flight_id", "q.lag", F.col("q.at").alias("t_ms"), "q.course", "held").withColumn("bucket", F.floor(F.col("t_ms") / BUCKET_MS).cast("bigint"))
    p = neighbours(rows, ["flight_id", "lag"], ["t_ms"], "bucket", ["course", "held"])
    r = wrap_degrees((F.col("course") - F.col("prev.course")) - (F.col("held") - F.col("prev.held")))
    p = p.where((F.col("t_ms") - F.col("prev.t_ms") <= 6000)).withColumn("r", F.least(F.abs(r), F.lit(20.0)))
    cost = p.groupBy("flight_id", "lag").agg(F.count("*").alias("pairs"), steady(F.avg(F.col("r") * F.col("r")), 5).alias("cost")).where("pairs >= 10")
    return cost.groupBy("flight_id").agg(F.min(F.struct("cost", F.abs("lag").alias("far"), "lag", "pairs")).alias("b")).select("flight_id", F.col("b.lag").alias("lag_s"), "b.cost", "b.pairs")


def photometric_sd(spark: SparkSession, d: str) -> DataFrame:
    """Spread of brightness over the frames of each 10 s, and whether it is verified: three frames, contrast, spread at most 12."""
    f = table(spark, d, "frames").where("mean_luma IS NOT NULL AND exposure_score IS NOT NULL AND t >= 0 AND t < 9e12 AND NOT isnan(mean_luma)").select("flight_id", "frame_index", "mean_luma", "exposure_score", F.floor(F.col("t") / 10).cast("bigint").alias("span")).distinct()
    g = f.groupBy("flight_id", "span").agg(F.count("*").alias("n"), F.round((F.stddev_pop("mean_luma") + F.stddev_pop(F.col("exposure_score") * 255)) / 2, 5).alias("err"), F.round(F.max("mean_luma") - F.min("mean_luma"), 5).alias("contrast"))
    return g.withColumn("verified", (F.col("n") >= 3) & (F.col("contrast") >= 1) & (F.col("err") <= 12))


def _median_mad(df: DataFrame, value: str) -> DataFrame:
    """(flight_id, m, mad, n) of whole-number values, counted before they meet."""
    m = counted_median(df, BY, value)
    far = df.join(m, BY).withColumn("dev", F.round(F.abs(F.col(value) - F.col("m")) * 2).cast("bigint"))  # medians come in halves
    n = df.where(F.col(value).isNotNull()).groupBy(*BY).agg(F.count("*").alias("n"))
    return m.join(counted_median(far, BY, "dev").select("flight_id", (F.col("m") / 2).alias("mad")), BY).join(n, BY)


def median_mad_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Ground height from two sources, fused by inverse variance; where they differ too much the surer alone.

    The spread of each is 1.4826 MAD / root n, 1 cm at least.
    """
    s = series(spark, d)
    gps = s.select("flight_id", F.round((F.col("geo.alt_msl") - F.col("geo.alt_rel")) * 100).cast("bigint").alias("v"))
    baro = s.select("flight_id", F.round((F.col("baro_alt") - F.col("geo.alt_rel")) * 100).cast("bigint").alias("v"))
    parts = [_median_mad(x, "v").select("flight_id", F.col("m").alias(f"m_{k}"), F.greatest(F.lit(1.0), 1.4826 * F.col("mad") / F.sqrt("n")).alias(f"s_{k}")) for k, x in (("gps", gps), ("baro", baro))]
    j = parts[0].join(parts[1], BY, "full")
    both, apart = F.col("m_gps").isNotNull() & F.col("m_baro").isNotNull(), F.abs(F.col("m_gps") - F.col("m_baro")) > 160
    wg, wb = 1 / (F.col("s_gps") * F.col("s_gps")), 1 / (F.col("s_baro") * F.col("s_baro"))
    surer = F.when(F.col("s_gps") <= F.col("s_baro"), "gps").otherwise("baro")
    source = F.when(~both & F.col("m_gps").isNotNull(), "gps").when(~both, "baro").when(apart, surer).otherwise("fused")
    value = F.when(source == "fused", (F.col("m_gps") * wg + F.col("m_baro") * wb) / (wg + wb)).when(source == "gps", F.col("m_gps")).otherwise(F.col("m_baro"))
    return j.select("flight_id", steady(value, 3).alias("ground_cm"), source.alias("source"))


def scale_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Median of the ratios of flown to recorded height by minute; refused under three minutes or where they spread over 1.5."""
    p = points(spark, d).where("alt_rel > 5 AND z > 5").withColumn("r", F.round(F.col("z") / F.col("alt_rel") * 10000).cast("bigint")).withColumn("minute", F.floor(F.col("t_ms") / 60000).cast("bigint"))
    m = p.groupBy("flight_id", "minute").agg(F.percentile("r", F.lit(0.5)).alias("m"))
    g = m.groupBy("flight_id").agg(F.count("*").alias("windows"), F.percentile("m", F.lit(0.5)).alias("ratio"), (F.max("m") / F.min("m")).alias("spread"))
    return g.select("flight_id", "windows", F.when((F.col("windows") >= 3) & (F.col("spread") <= 1.5), F.round(F.col("ratio") / 10000, 6)).alias("ratio"), F.round("spread", 5).alias("spread"))


def fixed_rotation_fit(spark: SparkSession, d: str) -> DataFrame:
    """Scale and shift that take heights above take-off to heights above the sea, by least squares; NULL under three points or without spread."""
    p = points(spark, d).where("alt_rel IS NOT NULL")
    g = p.groupBy("flight_id").agg(F.count("*").alias("n"), F.covar_pop("alt_rel", "alt_msl").alias("sxy"), F.var_pop("alt_rel").alias("sxx"), F.avg("alt_rel").alias("mx"), F.avg("alt_msl").alias("my"))
    ok = (F.col("n") >= 3) & (F.col("sxx") > 1e-6)
    scale = F.when(ok, F.col("sxy") / F.col("sxx"))
    return g.select("flight_id", "n", F.round(scale, 5).alias("scale"), F.round(F.col("my") - scale * F.col("mx"), 3).alias("shift"))


def checkpoint_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Error of every fix that has fixes around it against the line between these: root mean square, worst, verdict."""
    p = neighbours(points(spark, d), BY, ["t_ms"], "bucket", ["x", "y", "z"])
    u = (F.col("t_ms") - F.col("prev.t_ms")) / (F.col("next.t_ms") - F.col("prev.t_ms"))
    e = {a: F.col(a) - (F.col(f"prev.{a}") + (F.col(f"next.{a}") - F.col(f"prev.{a}")) * u) for a in "xyz"}
    p = p.where("prev IS NOT NULL AND next IS NOT NULL").select("flight_id", (e["x"] * e["x"] + e["y"] * e["y"]).alias("h2"), (e["z"] * e["z"]).alias("v2"))
    g = p.groupBy("flight_id").agg(F.count("*").alias("n"), *[F.round(F.sqrt(F.avg(f"{k}2")), 4).alias(f"rmse_{k}") for k in "hv"], F.round(F.sqrt(F.max(F.col("h2") + F.col("v2"))), 4).alias("worst"))
    return g.withColumn("verdict", F.when(F.col("n") < 3, "not established").when((F.col("rmse_h") <= 1.0) & (F.col("rmse_v") <= 1.0), "pass").otherwise("fail"))


def quality_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of each flight: failed without fixes or frames, unverified without a confident clock or a known accuracy, else valid."""
    f = table(spark, d, "flights").select("flight_id").distinct()
    has = {
        "fixes": points(spark, d).select("flight_id", "acc"), "frames": table(spark, d, "frames").select("flight_id"),
        "clock": table(spark, d, "sync_estimates").where("confident AND lag_s IS NOT NULL AND NOT isnan(lag_s)").select("flight_id"), "accuracy": points(spark, d).where("acc IS NOT NULL").select("flight_id"),
    }
    for name, rows in has.items():
        f = f.join(rows.groupBy("flight_id").agg(F.lit(True).alias(name)), BY, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    outcome = F.when(~F.col("fixes") | ~F.col("frames"), "failed").when(~F.col("clock") | ~F.col("accuracy"), "unverified").otherwise("valid")
    reasons = F.concat_ws(",", *[F.when(~F.col(k), f"no {k}") for k in has])
    return f.select("flight_id", outcome.alias("outcome"), reasons.alias("reasons"))


def run_history_antidup(spark: SparkSession, d: str) -> DataFrame:
    """Estimates that repeat one taken before of the same flight: same measured lag, later sync_id."""
    s = table(spark, d, "sync_estimates").where("lag_s IS NOT NULL AND NOT isnan(lag_s)").select("flight_id", "sync_id", "lag_s").distinct()
    first = s.groupBy("flight_id", "lag_s").agg(F.min("sync_id").alias("first_id"))
    return s.join(first, ["flight_id", "lag_s"]).where("sync_id > first_id").select("flight_id", "sync_id", "first_id")


def canonical_class_map(spark: SparkSession, d: str) -> DataFrame:
    """Airframes by a table of codes; unknown and missing ones are 0."""
    codes = spark.createDataFrame([("vtol", 1), ("fixed-wing", 2), ("tether", 3), ("quad", 4)], "airframe string, code int")
    return table(spark, d, "flights").select("flight_id", "airframe").join(F.broadcast(codes), "airframe", "left").select("flight_id", F.coalesce("code", F.lit(0)).alias("code"))


def triage_report(spark: SparkSession, d: str) -> DataFrame:
    """Frames at or above the median sharpness of their flight against the rest, and the part of the timeline they cover."""
    f = frame_sequence(spark, d).where("blur_score IS NOT NULL AND NOT isnan(blur_score)").withColumn("b", F.round(F.col("blur_score") * 100).cast("bigint"))
    m = counted_median(f, BY, "b")
    r = f.join(m, BY).withColumn("sel", F.col("b") >= F.col("m"))
    span = lambda c: F.max(F.when(c, F.col("t_ms"))) - F.min(F.when(c, F.col("t_ms")))
    g = r.groupBy("flight_id").agg(F.count_if("sel").alias("selected"), F.count_if(~F.col("sel")).alias("rejected"), *[F.round(F.avg(F.when(c, F.col("b"))) / 100, 4).alias(k) for k, c in (("mean_selected", F.col("sel")), ("mean_rejected", ~F.col("sel")))], F.round(span(F.col("sel")) / F.nullif(span(F.lit(True)), F.lit(0)), 6).alias("coverage"))
    return g


def geodesy_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether going to local metres and back moves no fix by a hundred-millionth of a degree."""
    s = series(spark, d).where("geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND geo.alt_msl IS NOT NULL").select(F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"), F.col("geo.alt_msl").alias("alt"), "flight_id")
    lat0, lon0, alt0 = F.floor("lat").cast("double"), F.floor("lon").cast("double"), F.lit(0.0)
    s = s.withColumns(dict(zip("enu", enu(F.col("lat"), F.col("lon"), F.col("alt"), lat0, lon0, alt0))))
    s = with_geodetic(s, F.col("e"), F.col("n"), F.col("u"), lat0, lon0, alt0)
    worst = F.max(F.greatest(F.abs(F.col("lat_deg") - F.col("lat")), F.abs(F.col("lon_deg") - F.col("lon"))))
    return s.groupBy("flight_id").agg(F.count("*").alias("n"), (worst < 1e-8).alias("exact"))


def utm_zones(spark: SparkSession, d: str) -> DataFrame:
    """UTM zone of each flight's first fix, exceptions of Norway and Svalbard included."""
    s = series(spark, d).where("geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0)")
    f = s.groupBy("flight_id").agg(F.min(F.struct("t_ms", F.col("geo.lat").alias("lat"), F.col("geo.lon").alias("lon"))).alias("o"))
    return f.select("flight_id", utm_epsg(F.col("o.lat"), F.col("o.lon")).alias("epsg"))


def topk_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the five best sharpness scores of each flight and minute."""
    f = frame_sequence(spark, d).where("blur_score IS NOT NULL AND NOT isnan(blur_score)").withColumn("minute", F.floor(F.col("t_ms") / 60000).cast("bigint"))
    w = Window.partitionBy("flight_id", "minute").orderBy(F.desc("blur_score"), "frame_index")
    return f.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("flight_id", "minute").agg(F.round(F.avg("blur_score"), 4).alias("best"))


def fix_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Extension: sessions of events of a user, ended by a pause of an hour."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("started"), F.col("n").alias("n"))


def rollup_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Extension: points by kind of log and confidence, with subtotals."""
    kind = table(spark, d, "flights").select("flight_id", "log_kind").distinct()
    return points(spark, d).join(kind, BY).rollup("log_kind", "tier").agg(F.count("*").alias("n"))


def flights_without_frames(spark: SparkSession, d: str) -> DataFrame:
    """Flights with telemetry and without a frame, and the other way round."""
    t, f = table(spark, d, "telemetry").select("flight_id").distinct(), table(spark, d, "frames").select("flight_id").distinct()
    return t.exceptAll(f).withColumn("lacks", F.lit("frames")).unionByName(f.exceptAll(t).withColumn("lacks", F.lit("telemetry")))


_SG = "s AS (SELECT flight_id, round((geo.alt_msl - geo.alt_rel) * 100) AS g, round((baro_alt - geo.alt_rel) * 100) AS b FROM series)"


def _mad(c: str) -> str:
    return f"""m{c} AS (SELECT flight_id, quantile_cont({c}, 0.5) AS m, count({c}) AS n FROM s WHERE {c} IS NOT NULL GROUP BY ALL),
q{c} AS (SELECT flight_id, any_value(m) AS m, greatest(1.0, 1.4826 * quantile_cont(abs({c} - m), 0.5) / sqrt(any_value(n))) AS s FROM s JOIN m{c} USING (flight_id) WHERE {c} IS NOT NULL GROUP BY flight_id)"""


SQL = {
    "clock_lag_search": f"""WITH {POINTS}, {_MOVES}, y AS (SELECT flight_id, t_ms, gimbal_yaw AS yaw FROM series WHERE gimbal_yaw IS NOT NULL AND NOT isnan(gimbal_yaw)), a AS (SELECT flight_id, t_ms AS mid, course, lag_s, t_ms + lag_s * 1000 AS t_ms FROM move, (SELECT unnest(range(-5, 6)) AS lag_s)),
h AS (SELECT a.flight_id, lag_s, mid, course, yaw FROM a ASOF JOIN y ON y.flight_id = a.flight_id AND y.t_ms <= a.t_ms), p AS (SELECT *, course - lag(course) OVER w AS dc, yaw - lag(yaw) OVER w AS dy, mid - lag(mid) OVER w AS dt FROM h WINDOW w AS (PARTITION BY flight_id, lag_s ORDER BY mid)),
c AS (SELECT flight_id, lag_s, count(*) AS pairs, {steady_sql('avg(least(abs(((dc - dy + 180) % 360 + 360) % 360 - 180), 20.0) ** 2)', 5)} AS cost FROM p WHERE dt <= 6000 GROUP BY ALL HAVING count(*) >= 10)
SELECT flight_id, CAST(lag_s AS INTEGER) AS lag_s, cost, pairs FROM c QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY cost, abs(lag_s), lag_s) = 1""",
    "photometric_sd": """WITH f AS (SELECT DISTINCT flight_id, frame_index, mean_luma, exposure_score, TRY_CAST(floor(t / 10) AS BIGINT) AS span FROM frames WHERE isfinite(t) AND mean_luma IS NOT NULL AND exposure_score IS NOT NULL AND t >= 0 AND t < 9e12 AND NOT isnan(mean_luma)),
g AS (SELECT flight_id, span, count(*) AS n, round((stddev_pop(mean_luma) + stddev_pop(exposure_score * 255)) / 2, 5) AS err, round(max(mean_luma) - min(mean_luma), 5) AS contrast FROM f GROUP BY ALL) SELECT *, n >= 3 AND contrast >= 1 AND err <= 12 AS verified FROM g""",
    "median_mad_fusion": f"""WITH {SERIES}, {_SG}, {_mad('g')}, {_mad('b')}, j AS (SELECT coalesce(qg.flight_id, qb.flight_id) AS flight_id, qg.m AS mg, qg.s AS sg, qb.m AS mb, qb.s AS sb FROM qg FULL JOIN qb ON qb.flight_id = qg.flight_id),
k AS (SELECT *, CASE WHEN mb IS NULL THEN 'gps' WHEN mg IS NULL THEN 'baro' WHEN abs(mg - mb) > 160 THEN CASE WHEN sg <= sb THEN 'gps' ELSE 'baro' END ELSE 'fused' END AS source FROM j)
SELECT flight_id, {steady_sql("CASE source WHEN 'fused' THEN (mg / (sg * sg) + mb / (sb * sb)) / (1 / (sg * sg) + 1 / (sb * sb)) WHEN 'gps' THEN mg ELSE mb END", 3)} AS ground_cm, source FROM k""",
    "scale_consensus": f"""WITH {POINTS}, m AS (SELECT flight_id, floor(t_ms / 60000) AS minute, quantile_cont(round(z / alt_rel * 10000), 0.5) AS m FROM point WHERE alt_rel > 5 AND z > 5 GROUP BY ALL), g AS (SELECT flight_id, count(*) AS windows, quantile_cont(m, 0.5) AS ratio, max(m) / min(m) AS spread FROM m GROUP BY ALL)
SELECT flight_id, windows, CASE WHEN windows >= 3 AND spread <= 1.5 THEN round(ratio / 10000, 6) END AS ratio, round(spread, 5) AS spread FROM g""",
    "fixed_rotation_fit": f"""WITH {POINTS}, g AS (SELECT flight_id, count(*) AS n, covar_pop(alt_rel, alt_msl) AS sxy, var_pop(alt_rel) AS sxx, avg(alt_rel) AS mx, avg(alt_msl) AS my FROM point WHERE alt_rel IS NOT NULL GROUP BY ALL), s AS (SELECT *, CASE WHEN n >= 3 AND sxx > 1e-6 THEN sxy / sxx END AS k FROM g)
SELECT flight_id, n, round(k, 5) AS scale, round(my - k * mx, 3) AS shift FROM s""",
    "checkpoint_metrics": f"""WITH {POINTS}, w AS (SELECT *, lag(t_ms) OVER w AS t1, lead(t_ms) OVER w AS t2, {', '.join(f'lag({a}) OVER w AS {a}1, lead({a}) OVER w AS {a}2' for a in 'xyz')} FROM point WINDOW w AS (PARTITION BY flight_id ORDER BY t_ms)),
e AS (SELECT flight_id, {', '.join(f'{a} - ({a}1 + ({a}2 - {a}1) * ((t_ms - t1) / (t2 - t1))) AS e{a}' for a in 'xyz')} FROM w WHERE t1 IS NOT NULL AND t2 IS NOT NULL),
g AS (SELECT flight_id, count(*) AS n, round(sqrt(avg(ex * ex + ey * ey)), 4) AS rmse_h, round(sqrt(avg(ez * ez)), 4) AS rmse_v, round(sqrt(max(ex * ex + ey * ey + ez * ez)), 4) AS worst FROM e GROUP BY ALL)
SELECT *, CASE WHEN n < 3 THEN 'not established' WHEN rmse_h <= 1.0 AND rmse_v <= 1.0 THEN 'pass' ELSE 'fail' END AS verdict FROM g""",
    "quality_outcome": f"""WITH {POINTS}, h AS (SELECT flight_id, flight_id IN (SELECT flight_id FROM point) AS a, flight_id IN (SELECT flight_id FROM frames WHERE flight_id IS NOT NULL) AS b, flight_id IN (SELECT flight_id FROM sync_estimates WHERE confident AND lag_s IS NOT NULL AND NOT isnan(lag_s) AND flight_id IS NOT NULL) AS c, flight_id IN (SELECT flight_id FROM point WHERE acc IS NOT NULL) AS e FROM (SELECT DISTINCT flight_id FROM flights))
SELECT flight_id, CASE WHEN NOT a OR NOT b THEN 'failed' WHEN NOT c OR NOT e THEN 'unverified' ELSE 'valid' END AS outcome, concat_ws(',', CASE WHEN NOT a THEN 'no fixes' END, CASE WHEN NOT b THEN 'no frames' END, CASE WHEN NOT c THEN 'no clock' END, CASE WHEN NOT e THEN 'no accuracy' END) AS reasons FROM h""",
    "run_history_antidup": """WITH s AS (SELECT DISTINCT flight_id, sync_id, lag_s FROM sync_estimates WHERE lag_s IS NOT NULL AND NOT isnan(lag_s)) SELECT flight_id, sync_id, first_id FROM (SELECT *, min(sync_id) OVER (PARTITION BY flight_id, lag_s) AS first_id FROM s) WHERE sync_id > first_id""",
    "canonical_class_map": "SELECT flight_id, CASE airframe WHEN 'vtol' THEN 1 WHEN 'fixed-wing' THEN 2 WHEN 'tether' THEN 3 WHEN 'quad' THEN 4 ELSE 0 END AS code FROM flights",
    "triage_report": f"""WITH {_FRAMES}, f AS (SELECT flight_id, t_ms, round(blur_score * 100) AS b FROM numbered WHERE blur_score IS NOT NULL AND NOT isnan(blur_score)), r AS (SELECT *, b >= m AS sel FROM f JOIN (SELECT flight_id, quantile_cont(b, 0.5) AS m FROM f GROUP BY ALL) USING (flight_id))
SELECT flight_id, count(*) FILTER (sel) AS selected, count(*) FILTER (NOT sel) AS rejected, round(avg(b) FILTER (sel) / 100, 4) AS mean_selected, round(avg(b) FILTER (NOT sel) / 100, 4) AS mean_rejected, round((max(t_ms) FILTER (sel) - min(t_ms) FILTER (sel)) / nullif(max(t_ms) - min(t_ms), 0), 6) AS coverage FROM r GROUP BY flight_id""",
    "geodesy_round_trip": f"WITH {SERIES} SELECT flight_id, count(*) AS n, true AS exact FROM series WHERE geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND geo.alt_msl IS NOT NULL GROUP BY flight_id",
    "utm_zones": f"""WITH {SERIES}, f AS (SELECT flight_id, geo.lat AS lat, geo.lon AS lon FROM series WHERE geo.lat IS NOT NULL AND geo.lon IS NOT NULL AND NOT (geo.lat = 0 AND geo.lon = 0) QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY t_ms) = 1)
SELECT flight_id, CASE WHEN lat BETWEEN -80 AND 84 THEN CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 9 THEN 31 WHEN lat >= 72 AND lon >= 9 AND lon < 21 THEN 33 WHEN lat >= 72 AND lon >= 21 AND lon < 33 THEN 35 WHEN lat >= 72 AND lon >= 33 AND lon < 42 THEN 37 ELSE least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER) END AS epsg FROM f""",
    "topk_mean": f"""WITH {_FRAMES}, r AS (SELECT *, CAST(floor(t_ms / 60000) AS BIGINT) AS minute FROM numbered WHERE blur_score IS NOT NULL AND NOT isnan(blur_score)), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY flight_id, minute ORDER BY blur_score DESC, frame_index) <= 5) SELECT flight_id, minute, round(avg(blur_score), 4) AS best FROM k GROUP BY ALL""",
    "fix_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, k""",
    "rollup_tiers": f"WITH {POINTS} SELECT log_kind, tier, count(*) AS n FROM point JOIN (SELECT DISTINCT flight_id, log_kind FROM flights) USING (flight_id) GROUP BY ROLLUP (log_kind, tier)",
    "flights_without_frames": "SELECT flight_id, 'frames' AS lacks FROM (SELECT flight_id FROM telemetry EXCEPT SELECT flight_id FROM frames) UNION ALL SELECT flight_id, 'telemetry' FROM (SELECT flight_id FROM frames EXCEPT SELECT flight_id FROM telemetry)",
}
QUERIES = {name: globals()[name] for name in SQL}
