"""Areas of polygons, and what lies inside them, any polygon: hollow, or crossing itself (then by odd and even).

Defined results
---------------
* Corners in the order of ``seq``; the last is joined with the first. Fewer than three corners: area 0, nothing inside.
* NULL coordinates: not used. A point on an edge is inside where the edge is the lower or left one. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(corners: DataFrame, by: list[str], seq: str) -> DataFrame:
    """corners: (by, seq, x, y). Result: (by, x, y, x2, y2), an edge from each corner to the next. A polygon is one task's work."""
    w = Window.partitionBy(*by).orderBy(seq)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return corners.where("x IS NOT NULL AND y IS NOT NULL").select(*by, "x", "y", nxt("x").alias("x2"), nxt("y").alias("y2"), F.count("*").over(whole).alias("n")).where("n >= 3").drop("n")


def polygon_areas(corners: DataFrame, by: list[str], seq: str) -> DataFrame:
    """(by, n, area, length): the area by signed triangles, and the length around."""
    all_of = corners.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"))
    e = edges(corners, by, seq).groupBy(*by).agg((F.abs(F.sum(F.col("x") * F.col("y2") - F.col("y") * F.col("x2"))) / 2).alias("area"), F.sum(F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))).alias("length"))
    return all_of.join(e, by, "left").fillna(0.0, ["area", "length"])


def inside(points: DataFrame, corners: DataFrame, by: list[str], seq: str, band: float) -> DataFrame:
    """points: (by, x, y and any other columns that can be grouped by), each row once. Those inside the polygon of their key, by the parity of the edges to their left.

    Edges meet points by bands of height ``band``: an edge is copied to the bands it passes, and a point asks its own only.
    """
    of = lambda y: F.floor(F.col(y) / band).cast("bigint")
    e = edges(corners, by, seq).where("y <> y2").withColumn("band", F.explode(F.sequence(F.least(of("y"), of("y2")), F.greatest(of("y"), of("y2")))))
    e = e.select(*by, "band", *[F.col(c).alias(f"e_{c}") for c in ("x", "y", "x2", "y2")])
    p = points.withColumn("band", of("y"))
    between = (F.col("e_y") > F.col("y")) != (F.col("e_y2") > F.col("y"))
    left = F.col("x") >= F.col("e_x") + (F.col("y") - F.col("e_y")) / (F.col("e_y2") - F.col("e_y")) * (F.col("e_x2") - F.col("e_x"))
    odd = p.join(e, [*by, "band"]).where(between & left).groupBy(*points.columns).agg(F.count("*").alias("__n")).where("__n % 2 = 1")
    return odd.select(*points.columns)
