"""Flight logs as they come: subtitle sidecars, CSV tables of any header, GPX tracks, survey control in JSON.

Readers take a path, a folder or a pattern. Files are read whole, a row each, and taken apart by built-in expressions or,
for CSV, by the drifting-schema reader; so a folder of many thousand logs is read in parallel and needs no schema pass.
``load_logs`` tells the kinds of logs apart and puts them on their videos' clocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.field_names import normal
from kestrelgrid.functions.geodesy import enu
from kestrelgrid.operators.schema_drift import typed_records

#: Quantities read from CSV logs, and their kinds.
COLUMNS = {"time": "seconds", "latitude": "degrees", "longitude": "degrees", "alt_msl": "metres", "alt_rel": "metres", "yaw": "degrees", "pitch": "degrees", "roll": "degrees", "accuracy_h": "metres", "accuracy_v": "metres", "satellites": "count", "fix": "text", "is_video": "flag"}
# The names of each quantity in CSV logs, the most trusted first, as field_names.normal() writes them.
NAMES = {
    "time": ["video_time_s", "video_time", "time", "time_stamp", "timestamp", "elapsed_time", "t", "t_s", "time_s"],
    "latitude": ["latitude", "lat", "drone_lat", "gps_lat"],
    "longitude": ["longitude", "long", "lon", "lng", "drone_lon", "gps_lon"],
    "alt_msl": ["altitude_above_sea_level", "altitude_above_sealevel", "altitude", "abs_alt", "drone_altitude_m", "alt_msl"],
    "alt_rel": ["height_above_takeoff", "relative_altitude", "altitude_above_ground", "rel_alt", "height", "alt_rel"],
    "pitch": ["gimbal_pitch", "pitch"], "roll": ["gimbal_roll", "roll"], "yaw": ["gimbal_heading", "gimbal_yaw", "compass_heading", "yaw"],
    "accuracy_h": ["accuracy_h", "horizontal_accuracy", "h_accuracy", "h_acc", "gps_h_acc", "eph", "rtk_std_h"],
    "accuracy_v": ["accuracy_v", "vertical_accuracy", "v_accuracy", "v_acc", "gps_v_acc", "epv", "rtk_std_v", "rtk_std_hgt"],
    "satellites": ["satellites", "n_sats"], "fix": ["rtk_fix", "rtk_status", "fix_type", "gps_fix", "gps_status"], "is_video": ["is_video", "is_photo"],
}
VIDEO_CLOCK = ("video_time_s", "video_time")


def candidates(headers: list[str]) -> dict[str, list[str]]:
    """Of each quantity all header names that carry it, the most trusted first; of equal names in the order of the file."""
    by_name: dict[str, list[str]] = {}
    for header in headers:
        by_name.setdefault(normal(header), []).append(header)
    found = {q: [h for name in names for h in by_name.get(name, [])] for q, names in NAMES.items()}
    return {q: held for q, held in found.items() if held}


def first_candidates(headers: list[str]) -> dict[str, str]:
    """Of each quantity its most trusted header name."""
    return {q: held[0] for q, held in candidates(headers).items()}


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r", "").alias("text"))


def read_srt(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, latitude, longitude, alt_rel, alt_msl, focal_len, wallclock) of each block with a time line.

    A field is looked up by its name in brackets, wherever it stands; what a block lacks is NULL.
    """
    return _srt_rows(_whole(spark, path))


def _srt_rows(texts: DataFrame) -> DataFrame:
    block = texts.select("file", F.explode(F.split("text", r"\n[ \t]*\n+")).alias("b"))
    head = r"(\d+):(\d\d):(\d\d)[,.](\d{1,3})\s*-->"
    part = lambda k: F.regexp_extract("b", head, k).try_cast("bigint")
    value = lambda *names: F.coalesce(*[F.nullif(F.regexp_extract("b", rf"(?i)\b{n}\s*[:=]\s*([+-]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double") for n in names])
    t = part(1) * 3600 + part(2) * 60 + part(3) + F.rpad(F.regexp_extract("b", head, 4), 3, "0").try_cast("bigint") / 1000
    clock = F.nullif(F.regexp_extract("b", r"(\d{4}[-.]\d\d[-.]\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?)", 1), F.lit(""))
    return block.where(F.col("b").rlike(head)).select("file", t.alias("t"), value("latitude").alias("latitude"), value("longitude", "longtitude").alias("longitude"), value("rel_alt").alias("alt_rel"), value("abs_alt", "altitude").alias("alt_msl"), value("focal_len").alias("focal_len"), clock.alias("wallclock"))


def read_csv_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec_no, a column for each of COLUMNS, failed) of CSV logs; headers, delimiters and units may differ by file.

    Of several columns of one quantity a row takes the most trusted that isn't blank in it.
    """
    return _csv_rows(_whole(spark, path))


def _csv_rows(texts: DataFrame) -> DataFrame:
    files = texts.select(F.xxhash64("file").alias("file_id"), F.col("file").alias("producer"), F.lit(None).cast("string").alias("flight_id"), F.lit("csv").alias("layout"), F.col("text").alias("payload"))
    return typed_records(files, COLUMNS, candidates).withColumnRenamed("producer", "file").drop("file_id", "flight_id")


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, latitude, longitude, alt_msl) of track points with a time, of way points in files without track points; t in seconds from the file's first; no height is 0."""
    return _gpx_rows(_whole(spark, path))


def _gpx_rows(texts: DataFrame) -> DataFrame:
    track, way = (F.regexp_extract_all("text", F.lit(rf"(?s)(<{tag}\b[^>]*/>|<{tag}\b.*?</{tag}>)"), 1) for tag in ("trkpt", "wpt"))
    p = texts.select("file", F.explode(F.when(F.size(track) > 0, track).otherwise(way)).alias("p"))
    number = lambda pattern: F.nullif(F.trim(F.regexp_extract("p", pattern, 1)), F.lit("")).try_cast("double")
    at = F.unix_micros(F.try_to_timestamp(F.trim(F.regexp_extract("p", r"<time>([^<]*)</time>", 1))))
    raw = p.select("file", number(r"""\blat=["']([^"']*)["']""").alias("latitude"), number(r"""\blon=["']([^"']*)["']""").alias("longitude"), F.coalesce(number(r"<ele>([^<]*)</ele>"), F.lit(0.0)).alias("alt_msl"), at.alias("us"))
    timed = raw.where("us IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL")
    first = timed.groupBy("file").agg(F.min("us").alias("first"))
    return timed.join(first, "file").select("file", ((F.col("us") - F.col("first")) / 1e6).alias("t"), "latitude", "longitude", "alt_msl")


def _kind_of(file: Column, text: Column) -> Column:
    """The kind of a log by its name's ending, else by what it begins with."""
    ending, head = F.lower(F.regexp_extract(file, r"\.([A-Za-z]+)$", 1)), F.left(text, F.lit(4096))
    return F.when(ending.isin("srt", "csv", "gpx"), ending).when(head.rlike(r"\d{2}:\d{2}:\d{2}[,.]\d+\s*-->"), "srt").when(F.ltrim(head).startswith("<?xml") | F.lower(head).contains("<gpx"), "gpx").otherwise("csv")


def load_logs(spark: SparkSession, path: str, *, video_s: float | None = None, offset_s: float | None = None) -> DataFrame:
    """Samples of logs of any kind, on their videos' clocks.

    (file, format, t, latitude, longitude, alt_msl, alt_rel, yaw, pitch, roll, accuracy_h, accuracy_v, is_video, offset_s, offset_source, coverage).
    The log's time at the video's start is, in this order: ``offset_s`` where given (``explicit``), 0 for logs whose CSV time
    counts from the video's start (``video_clock``), the start of the only recorded run about as long as ``video_s``
    (``recording_flag``), else 0 (``assumed_zero``). coverage is the part of the video between a file's first and last sample.
    """
    texts = _whole(spark, path).withColumn("format", _kind_of(F.col("file"), F.col("text")))
    names = ["latitude", "longitude", "alt_msl", "alt_rel", "yaw", "pitch", "roll", "accuracy_h", "accuracy_v", "is_video"]
    readers = {"srt": _srt_rows, "csv": lambda x: _csv_rows(x).withColumnRenamed("time", "t"), "gpx": _gpx_rows}
    every = None
    for kind, read in readers.items():
        rows = read(texts.where(F.col("format") == kind))
        own = [F.col(n) if n in rows.columns else F.lit(None).cast("boolean" if n == "is_video" else "double").alias(n) for n in names]
        part = rows.where("t IS NOT NULL").select("file", F.lit(kind).alias("format"), "t", *own)
        every = part if every is None else every.unionByName(part)
    header = F.split(F.regexp_extract("text", r"^([^\n]*)", 1), r"[,;|\t]")
    plain = F.transform(header, lambda h: F.lower(F.regexp_replace(h, r"[(\[][^()\[\]]*[)\]]\s*$", "")))
    counted = texts.where("format = 'csv'").select("file", F.arrays_overlap(F.transform(plain, F.trim), F.array(*[F.lit(n) for n in VIDEO_CLOCK])).alias("video_clock"))
    w = Window.partitionBy("file").orderBy("t")
    flagged = every.where("is_video IS NOT NULL").select("file", "t", "is_video", F.lag("is_video").over(w).alias("before"))
    runs = flagged.withColumn("run", F.count_if(F.col("is_video") & ~F.coalesce("before", F.lit(False))).over(w)).where("is_video").groupBy("file", "run").agg(F.min("t").alias("start"), (F.max("t") - F.min("t")).alias("lasts"))
    fits = runs.where(F.abs(F.col("lasts") - F.lit(video_s)) <= F.greatest(F.lit(2.0), F.lit(video_s) * 0.01)).groupBy("file").agg(F.count("*").alias("n"), F.min("start").alias("start")).where("n = 1")
    spans = every.groupBy("file").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).join(counted, "file", "left").join(fits, "file", "left")
    choices = [(F.lit(offset_s is not None), F.lit(offset_s), "explicit"), (F.coalesce("video_clock", F.lit(False)), F.lit(0.0), "video_clock"), (F.col("n") == 1, F.col("start"), "recording_flag")]
    offset, source = F.lit(0.0), F.lit("assumed_zero")
    for holds, value, name in reversed(choices):
        offset, source = F.when(holds, value.cast("double")).otherwise(offset), F.when(holds, name).otherwise(source)
    spans = spans.select("file", "lo", "hi", offset.alias("offset_s"), source.alias("offset_source"))
    covered = F.greatest(F.lit(0.0), F.least(F.col("hi") - F.col("offset_s"), F.lit(video_s)) - F.greatest(F.col("lo") - F.col("offset_s"), F.lit(0.0)))
    spans = spans.select("file", "offset_s", "offset_source", (covered / F.nullif(F.lit(video_s).cast("double"), F.lit(0.0)) if video_s else F.lit(None).cast("double")).alias("coverage"))
    return every.join(spans, "file").withColumn("t", F.col("t") - F.col("offset_s"))


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """(file, measurement_set_id, role, id, x, y, z, lat, lon, alt) of survey files; raises where ids repeat or positions lie off the globe."""
    point = "array<struct<id:string,local_xyz:array<double>,geo:struct<lat:double,lon:double,alt_msl:double>>>"
    raw = spark.read.json(path, multiLine=True, schema=f"coordinate_frame string, measurement_set_id string, controls {point}, checkpoints {point}").withColumn("file", F.input_file_name())
    both = [raw.select("file", "measurement_set_id", F.lit(role).alias("role"), F.explode(column).alias("p")) for role, column in (("control", "controls"), ("checkpoint", "checkpoints"))]
    p = both[0].unionByName(both[1]).select("file", "measurement_set_id", "role", "p.id", *[F.get("p.local_xyz", F.lit(k)).alias(a) for k, a in enumerate("xyz")], F.col("p.geo.lat").alias("lat"), F.col("p.geo.lon").alias("lon"), F.col("p.geo.alt_msl").alias("alt"))
    bad = p.where(~(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)) | F.col("id").isNull()).limit(1).count()
    twice = p.groupBy("file", "id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("control points need distinct ids and positions on the globe")
    return p


def check_control_network(points: DataFrame, *, local_m: float = 1e-8, surveyed_m: float = 1e-4) -> None:
    """Raises where a file of read_control_points() has fewer than three controls, controls on a line in either frame, or two points of any role in one place.

    Spreads are taken from moments; only points whose places round alike, or next to each other, are compared.
    """
    lat0, lon0, alt0 = (F.first_value(c).over(Window.partitionBy("file").orderBy("id")) for c in ("lat", "lon", "alt"))
    p = points.withColumns({"lat0": lat0, "lon0": lon0, "alt0": alt0})
    p = p.withColumns(dict(zip(("e", "n", "u"), enu(*[F.col(c) for c in ("lat", "lon", "alt", "lat0", "lon0", "alt0")]))))
    frames = {"local": (("x", "y", "z"), local_m, 1e-8), "surveyed": (("e", "n", "u"), surveyed_m, 1e-5)}
    controls = p.where("role = 'control'").groupBy("file")
    wanted = [F.count("*").alias("n")]
    for name, (axes, _, _) in frames.items():
        a, b, c = axes
        cov = [F.var_pop(a), F.var_pop(b), F.var_pop(c), F.covar_pop(a, b), F.covar_pop(a, c), F.covar_pop(b, c)]
        wanted += [v.alias(f"{name}{k}") for k, v in enumerate(cov)]
    g = controls.agg(*wanted)
    line = []
    for name, (_, _, least) in frames.items():
        xx, yy, zz, xy, xz, yz = (F.col(f"{name}{k}") for k in range(6))
        # the sum of the minors over the trace is the second eigenvalue where the third is small, without the loss of a closed form
        second = F.sqrt(F.greatest(F.lit(0.0), xx * yy - xy * xy + xx * zz - xz * xz + yy * zz - yz * yz) / F.nullif(xx + yy + zz, F.lit(0.0)))
        line.append(F.coalesce(second <= F.greatest(F.lit(least), 1e-7 * F.sqrt(xx + yy + zz)), F.lit(True)))
    bad = g.where((F.col("n") < 3) | line[0] | line[1]).limit(1).count()
    without = p.select("file").distinct().join(g, "file", "left_anti").limit(1).count()
    if bad or without:
        raise ValueError("a control network needs three controls that aren't on a line")
    for axes, within, _ in frames.values():
        cell = [F.floor(F.col(a) / (within * 4)).cast("bigint").alias(f"c{a}") for a in axes]
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
        q = p.select("file", "id", *axes, *cell)
        o = q.withColumn("o", around).select("file", F.col("id").alias("other"), *[F.col(a).alias(f"o{a}") for a in axes], *[(F.col(f"c{a}") + F.col(f"o.{s}")).alias(f"c{a}") for a, s in zip(axes, "ijk")])
        far = F.sqrt(sum((F.pow(F.col(a) - F.col(f"o{a}"), 2) for a in axes), F.lit(0.0)))
        if q.join(o, ["file", *[f"c{a}" for a in axes]]).where((F.col("id") < F.col("other")) & (far < within)).limit(1).count():
            raise ValueError("two points of a control network are in one place")
