"""Points and measurements as text formats, written in parts by the tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_HEADER = ["ply", "format ascii 1.0", "comment parts follow in the order of their names"]


def _number(name: str) -> Column:
    """A number to the millimetre, without needless digits."""
    return F.format_string("%.3f", F.col(name).cast("double"))


def xyz_lines(points: DataFrame) -> DataFrame:
    """Lines x y z, with r g b where there are such columns."""
    rgb = [F.col(c).cast("string") for c in ("r", "g", "b") if c in points.columns]
    return points.select(F.concat_ws(" ", *[_number(a) for a in "xyz"], *rgb).alias("value"))


def write_xyz(points: DataFrame, path: str) -> None:
    xyz_lines(points).write.text(path)


def write_ply(points: DataFrame, path: str) -> None:
    """``path``/header.ply and ``path``/body/part-*: joined in this order they are one ASCII PLY file."""
    spark = points.sparkSession
    n = points.count()
    properties = [f"property float {a}" for a in "xyz"] + [f"property uchar {c}" for c in ("confidence", "semantic_class") if c in points.columns]
    lines = [*_HEADER, f"element vertex {n}", *properties, "end_header"]
    extra = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("confidence", "semantic_class") if c in points.columns]
    points.select(F.concat_ws(" ", *[_number(a) for a in "xyz"], *extra).alias("value")).write.text(f"{path}/body")
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(f"{path}/header.ply")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Points of write_ply(): x, y, z and the properties its header names."""
    header = [r.value for r in spark.read.text(f"{path}/header.ply").toLocalIterator()]
    names = [line.split()[-1] for line in header if line.startswith("property")]
    cells = F.split("value", " ")
    kinds = {a: "double" for a in "xyz"}
    return spark.read.text(f"{path}/body").select(*[F.get(cells, F.lit(k)).try_cast(kinds.get(n, "int")).alias(n) for k, n in enumerate(names)])


def geojson_features(measurements: DataFrame) -> DataFrame:
    """A feature a line; measurements: (kind, points array<struct<lon,lat,alt>>, value, unit, label). Areas and volumes close their ring."""
    place = lambda p: F.array(F.round(p["lon"], 8), F.round(p["lat"], 8), F.round(p["alt"], 3))
    line = F.transform("points", place)
    ring = F.concat(line, F.slice(line, 1, 1))
    shape = F.when(F.col("kind") == "point", F.format_string('{"type":"Point","coordinates":%s}', F.to_json(F.get(line, F.lit(0))))).when(
        F.col("kind").isin("area", "volume"), F.format_string('{"type":"Polygon","coordinates":[%s]}', F.to_json(ring))
    ).otherwise(F.format_string('{"type":"LineString","coordinates":%s}', F.to_json(line)))
    facts = F.to_json(F.struct("kind", "value", "unit", "label"))
    return measurements.select(F.format_string('{"type":"Feature","geometry":%s,"properties":%s}', shape, facts).alias("value"))


def kml_placemarks(measurements: DataFrame) -> DataFrame:
    """A placemark a line, of the same measurements."""
    text = F.array_join(F.transform("points", lambda p: F.format_string("%.8f,%.8f,%.3f", p["lon"], p["lat"], p["alt"])), " ")
    label = F.replace(F.replace(F.coalesce("label", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return measurements.select(F.format_string("<Placemark><name>%s</name><LineString><coordinates>%s</coordinates></LineString></Placemark>", label, text).alias("value"))


def write_measurements(measurements: DataFrame, path: str, kind: str) -> None:
    """kind: geojson (a feature a line) or kml (a placemark a line); anything else raises."""
    makers = {"geojson": geojson_features, "kml": kml_placemarks}
    if kind not in makers:
        raise ValueError(f"unknown format {kind}")
    makers[kind](measurements).write.text(path)
