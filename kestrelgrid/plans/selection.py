"""Keyframe selection and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.operators.coverage import greedy_views
from kestrelgrid.operators.keyframes import select_keyframes
from kestrelgrid.plans.points import POINTS, points
from kestrelgrid.plans.sequence import frame_sequence, resample_interpolate
from kestrelgrid.sources.writers import geojson_features, xyz_lines


def keyframe_select_stateful(spark: SparkSession, d: str) -> DataFrame:
    """Keyframes of every flight by path flown, turn and sharpness."""
    at = resample_interpolate(spark, d).select("flight_id", "frame_index", "x", "y")
    f = frame_sequence(spark, d).select("flight_id", "frame_index", "t_ms", F.col("blur_score").alias("sharp")).join(at, ["flight_id", "frame_index"])
    return select_keyframes(f)


def xyz_export(spark: SparkSession, d: str) -> DataFrame:
    """Every point as a line of an XYZ file."""
    return xyz_lines(points(spark, d))


def geojson_export(spark: SparkSession, d: str) -> DataFrame:
    """The first fix of each flight as a GeoJSON feature."""
    p = points(spark, d).groupBy("flight_id").agg(F.min(F.struct("t_ms", "x", "y", "z")).alias("p"))
    place = F.array(F.struct(F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), F.col("p.z").alias("alt")))
    m = p.select(F.lit("point").alias("kind"), place.alias("points"), F.lit(0.0).alias("value"), F.lit("m").alias("unit"), F.col("flight_id").alias("label"))
    return geojson_features(m)


def dense_views(spark: SparkSession, d: str) -> DataFrame:
    """Views of each flight that see enough ground few others saw; a view's footprint is the cells of 10 m that its fixes stand in."""
    return greedy_views(points(spark, d).select("flight_id", "view", F.floor(F.col("x") / 10).cast("bigint").alias("i"), F.floor(F.col("y") / 10).cast("bigint").alias("j")).distinct())


SQL = {"xyz_export": f"WITH {POINTS} SELECT printf('%.3f %.3f %.3f', x, y, z) AS value FROM point"}
QUERIES = {name: globals()[name] for name in ("keyframe_select_stateful", "dense_views", "xyz_export", "geojson_export")}
