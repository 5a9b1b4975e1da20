"""Places of tracks from the pixels cameras see them at, by linear least squares on sums.

An observation is two linear equations in the place; their normal equations are nine sums for each track, solved in closed form.

Defined results
---------------
* Observations with a NULL or NaN: not used. Tracks of fewer than two observations, or whose rays don't fix a place: place NULL.
* Empty tables: no rows. Repeated observations weigh as often as they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import dot, rows as matrix_rows, turned, unit

R = [f"r{i}{j}" for i in range(3) for j in range(3)]


def triangulate(observations: DataFrame, by: list[str]) -> DataFrame:
    """observations: (by, cx, cy, cz, r00 .. r22, xn, yn): the camera's centre and rotation and the flat direction of the pixel (lens and focal length taken out).

    Result: (by, n, x, y, z).
    """
    o = observations
    for c in ("cx", "cy", "cz", "xn", "yn", *R):
        o = o.where(F.col(c).isNotNull() & ~F.isnan(c))
    seen = matrix_rows(turned([F.col(r) for r in R]))  # the camera's axes as rows
    # about the first camera, so that the sums stay small
    first = o.groupBy(*by).agg(F.min(F.struct("cx", "cy", "cz")).alias("o"))
    o = o.join(first, by)
    centre = [F.col(f"c{k}") - F.col(f"o.c{k}") for k in "xyz"]
    equations = {}
    for name, flat, axis in (("a", "xn", 0), ("b", "yn", 1)):
        row = [F.col(flat) * seen[2][k] - seen[axis][k] for k in range(3)]
        equations |= {f"{name}{k}": r for k, r in zip("xyz", row)} | {f"{name}c": dot(row, centre)}
    o = o.withColumns(equations)
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"), ("x", "c"), ("y", "c"), ("z", "c")]
    s = o.groupBy(*by).agg(F.count("*").alias("n"), F.first("o").alias("o"), *[F.sum(F.col(f"a{i}") * F.col(f"a{j}") + F.col(f"b{i}") * F.col(f"b{j}")).alias(f"{i}{j}") for i, j in pairs])
    xx, xy, xz, yy, yz, zz, xc, yc, zc = (F.col(f"{i}{j}") for i, j in pairs)
    minors = {"ax": yy * zz - yz * yz, "ay": xz * yz - xy * zz, "az": xy * yz - xz * yy, "by": xx * zz - xz * xz, "bz": xy * xz - xx * yz, "cz": xx * yy - xy * xy}
    s = s.withColumns(minors).withColumn("det", xx * F.col("ax") + xy * F.col("ay") + xz * F.col("az"))
    ok = (F.col("n") >= 2) & (F.col("det") > 1e-12 * F.pow(xx + yy + zz, 3))
    x, y, z = ((F.col(a) * xc + F.col(b) * yc + F.col(c) * zc) / F.col("det") for a, b, c in (("ax", "ay", "az"), ("ay", "by", "bz"), ("az", "bz", "cz")))
    return s.select(*by, "n", *[F.when(ok, F.col(f"o.c{k}") + v).alias(k) for k, v in zip("xyz", (x, y, z))])


def widest_angles(places: DataFrame, observations: DataFrame, by: list[str], order: str) -> DataFrame:
    """places: (by, x, y, z); observations: (by, cx, cy, cz, order). Result: (by, angle_deg): the largest angle at the place between the first camera by ``order`` and any other.

    The angle is at least half that of the widest pair, and costs no pairs.
    """
    o = observations.join(places.where("x IS NOT NULL").select(*by, "x", "y", "z"), by)
    ray = unit([F.col(k) - F.col(f"c{k}") for k in "xyz"])
    o = o.select(*by, order, *[r.alias(f"d{k}") for r, k in zip(ray, "xyz")]).where("dx IS NOT NULL")
    first = o.groupBy(*by).agg(F.min_by(F.struct("dx", "dy", "dz"), order).alias("f"))
    cosine = dot([F.col(f"d{k}") for k in "xyz"], [F.col(f"f.d{k}") for k in "xyz"])
    return o.join(first, by).groupBy(*by).agg(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.min(cosine))))).alias("angle_deg"))
