"""Records of two tables paired with the nearest in time for the same entity, within a tolerance.

Right records fall into time buckets as wide as the entity's tolerance; a left record looks into its own bucket and the
two beside it, which hold every right record within the tolerance. The join is on (entity, bucket), so an entity with a
third of all rows is spread over as many join keys as it has buckets, and a bucket holds only what one tolerance's
width of time holds: right records are first reduced to one per (entity, millisecond), so that is at most the tolerance
in milliseconds. Of what lies within the tolerance the smallest (distance, right id) is kept.

Defined results
---------------
* NULL times or entities, NULL, NaN or negative tolerances: no match. A tolerance of 0 matches equal times only.
* Equal distances: the smaller right id, be it before or after. Repeated right rows: no effect. Repeated left rows with
  one (entity, left id): one row; if such rows differ in time, the nearest match of any of them.
* Empty tables: no rows. Columns beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.functions.clock import floor_div


def match_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """left: (entity, left_id, t_ms bigint, tol_ms bigint); right: (entity, right_id, t_ms bigint, tol_ms bigint).

    tol_ms is the entity's tolerance, equal in all its rows on both sides. Result: (entity, left_id, right_id, apart_ms),
    a row for each left record with a match.
    """
    width = F.greatest(F.col("tol_ms"), F.lit(1))
    bucket = floor_div(F.col("t_ms"), width)
    known = F.col("entity").isNotNull() & F.col("t_ms").isNotNull() & (F.col("tol_ms") >= 0)
    r = (
        right.where(known & F.col("right_id").isNotNull())
        .select("entity", bucket.alias("bucket"), F.col("t_ms").alias("r_ms"), "right_id")
        .repartition("entity", "bucket")  # serves the aggregate and the join
        .groupBy("entity", "bucket", "r_ms")
        .agg(F.min("right_id").alias("right_id"))
    )
    lf = (
        left.where(known & F.col("left_id").isNotNull())
        .select("entity", "left_id", F.col("t_ms").alias("l_ms"), "tol_ms", bucket.alias("b"))
        .withColumn("bucket", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)))
    )
    apart = F.abs(F.col("l_ms") - F.col("r_ms"))
    return (
        lf.join(r, ["entity", "bucket"])
        .where(apart <= F.col("tol_ms"))
        .groupBy("entity", "left_id")
        .agg(F.min(F.struct(apart.alias("apart_ms"), "right_id")).alias("best"))
        .select("entity", "left_id", "best.right_id", "best.apart_ms")
    )
