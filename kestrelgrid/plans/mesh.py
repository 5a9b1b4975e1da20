"""Meshes of the height map, distance fields, nearest neighbours in space and samples of the surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.grid import voxel
from kestrelgrid.plans.geometry import _V, _views
from kestrelgrid.operators.polygons import inside, polygon_areas
from kestrelgrid.plans.points import POINTS, points
from kestrelgrid.plans.surface import _DSM, BY, CELL, RES, grid_dsm

#: Neighbours asked for, how far they are looked for, and how many deviations a point may stand out.
K, REACH, SIGMAS = 6, 12.0, 2.0
#: Distance field: voxel, truncation, and the reach of a point.
TSDF_VOXEL, TRUNC, SPLAT = 2.0, 2.0, 3.0


def _offsets(n: int, names: str = "ij") -> Column:
    """All steps of -n to n along each name, as an array of structs."""
    out = [[]]
    for name in names:
        out = [[*o, F.lit(k).alias(name)] for o in out for k in range(-n, n + 1)]
    return F.array(*[F.struct(*o) for o in out])


def _faces(spark: SparkSession, d: str) -> DataFrame:
    """Two triangles for each block of 2 x 2 known cells: (flight_id, three corners as (row, col))."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    c = grid_dsm(spark, d).withColumn("o", o).select("flight_id", (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"))
    b = c.groupBy(*CELL).agg(F.count("*").alias("n")).where("n = 4")
    p = lambda i, j: F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c"))
    return b.select("flight_id", F.explode(F.array(F.array(p(0, 0), p(0, 1), p(1, 0)), F.array(p(1, 1), p(1, 0), p(0, 1)))).alias("v"))


def mesh_watertight(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the height map's mesh, those with other than two faces, and whether there are none."""
    f = _faces(spark, d)
    edge = lambda a, b: F.struct(F.least(F.col("v")[a], F.col("v")[b]).alias("p"), F.greatest(F.col("v")[a], F.col("v")[b]).alias("q"))
    e = f.select("flight_id", F.explode(F.array(edge(0, 1), edge(1, 2), edge(0, 2))).alias("e")).groupBy("flight_id", "e").agg(F.count("*").alias("n"))
    return e.groupBy("flight_id").agg(F.count("*").alias("edges"), F.count_if(F.col("n") != 2).alias("open_edges"), (F.count_if(F.col("n") != 2) == 0).alias("watertight"))


def compact_vertices(spark: SparkSession, d: str) -> DataFrame:
    """Vertices that a face uses and those that none does."""
    used = _faces(spark, d).select("flight_id", F.explode("v").alias("p")).select("flight_id", F.col("p.r").alias("row"), F.col("p.c").alias("col")).distinct().withColumn("used", F.lit(True))
    return grid_dsm(spark, d).join(used, CELL, "left").groupBy("flight_id").agg(F.count("used").alias("used"), F.count_if(F.col("used").isNull()).alias("unused"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    v = {f"i{a}": voxel(a, 2.0) for a in "xyz"}
    return points(spark, d).withColumns(v).groupBy("flight_id", *v).agg(*[steady(F.avg(a), 3).alias(a) for a in "xyz"]).select("flight_id", F.concat_ws(":", "ix", "iy", "iz").alias("id"), "x", "y", "z")


def knn_outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    """Voxels whose mean distance to the six nearest others is at most two deviations over the flight's mean.

    Neighbours are looked for within 12 m, a missing one counts as 12 m away. A cell of 12 m holds at most 216 voxels, so
    what a voxel is compared with is bounded.
    """
    c = {f"c{a}": voxel(a, REACH) for a in "xyz"}
    p = _centroids(spark, d).withColumns(c)
    a = p.withColumn("o", F.explode(_offsets(1, "ijk"))).select("flight_id", F.col("id").alias("pid"), *[F.col(k).alias(f"p{k}") for k in "xyz"], *[(F.col(f"c{k}") + F.col(f"o.{s}")).alias(f"c{k}") for k, s in zip("xyz", "ijk")])
    dist = F.sqrt(sum((F.pow(F.col(k) - F.col(f"p{k}"), 2) for k in "xyz"), F.lit(0.0)))
    near = a.join(p, ["flight_id", *c]).where(F.col("id") != F.col("pid")).withColumn("d", steady(dist, 4)).where(F.col("d") < REACH)
    w = Window.partitionBy("flight_id", "pid").orderBy("d", "id")
    best = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= K).groupBy("flight_id", F.col("pid").alias("id")).agg(F.sum("d").alias("s"), F.count("*").alias("n"))
    m = p.select("flight_id", "id").join(best, ["flight_id", "id"], "left").withColumn("m", steady((F.coalesce("s", F.lit(0.0)) + (K - F.coalesce("n", F.lit(0))) * REACH) / K, 4))
    g = m.groupBy("flight_id").agg(steady(F.avg("m") + SIGMAS * F.stddev_pop("m"), 4).alias("limit"))
    return m.join(g, BY).where(F.col("m") <= F.col("limit")).select("flight_id", "id", "m")


def check_point_residuals(spark: SparkSession, d: str) -> DataFrame:
    """Each view's mean place against the nearest voxel within 4 m: root mean square of the horizontal and mean of the signed vertical residuals."""
    c = {f"c{a}": voxel(a, 4.0) for a in "xyz"}
    m = _centroids(spark, d).withColumns(c)
    v = _views(spark, d).withColumns(c).withColumn("o", F.explode(_offsets(1, "ijk")))
    a = v.select("flight_id", "view", *[F.col(k).alias(f"p{k}") for k in "xyz"], *[(F.col(f"c{k}") + F.col(f"o.{s}")).alias(f"c{k}") for k, s in zip("xyz", "ijk")])
    d3 = steady(F.sqrt(sum((F.pow(F.col(k) - F.col(f"p{k}"), 2) for k in "xyz"), F.lit(0.0))), 4)
    h2 = F.pow(F.col("x") - F.col("px"), 2) + F.pow(F.col("y") - F.col("py"), 2)
    j = a.join(m, ["flight_id", *c]).withColumn("d", d3).where("d <= 4")
    n = j.groupBy("flight_id", "view").agg(F.min(F.struct("d", "id", h2.alias("h2"), (F.col("z") - F.col("pz")).alias("dz"))).alias("b"))
    return n.groupBy("flight_id").agg(F.count("*").alias("n"), steady(F.sqrt(F.avg("b.h2")), 4).alias("rmse_h"), steady(F.avg("b.dz"), 4).alias("bias_v"))


def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """Surface at each view's mean place: bilinear where the four cells around are known, else of the cell it is in, NULL beyond."""
    box = points(spark, d).groupBy("flight_id").agg(F.min("x").alias("x_min"), F.max("y").alias("y_max"))
    v = _views(spark, d).join(box, BY).withColumns({"u": (F.col("x") - F.col("x_min")) / RES - 0.5, "w": (F.col("y_max") - F.col("y")) / RES - 0.5})
    v = v.select("flight_id", "view", "u", "w", F.floor("u").cast("bigint").alias("c0"), F.floor("w").cast("bigint").alias("r0"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    a = v.withColumn("o", F.explode(corners)).select("flight_id", "view", "u", "w", "c0", "r0", "o.i", "o.j", (F.col("r0") + F.col("o.i")).alias("row"), (F.col("c0") + F.col("o.j")).alias("col"))
    fu, fw = F.col("u") - F.col("c0"), F.col("w") - F.col("r0")
    share = F.when(F.col("i") == 1, fw).otherwise(1 - fw) * F.when(F.col("j") == 1, fu).otherwise(1 - fu)
    own = (F.col("row") == F.floor(F.col("w") + 0.5)) & (F.col("col") == F.floor(F.col("u") + 0.5))
    s = a.join(grid_dsm(spark, d).select(*CELL, "z"), CELL, "left").groupBy("flight_id", "view").agg(F.count("z").alias("n"), F.sum(F.col("z") * share).alias("mix"), F.max(F.when(own, F.col("z"))).alias("own"))
    return s.select("flight_id", "view", steady(F.when(F.col("n") == 4, F.col("mix")).otherwise(F.col("own")), 4).alias("z"), F.col("n").cast("int").alias("known"))


def _path_polygons(spark: SparkSession, d: str) -> DataFrame:
    """A polygon for each flight: the places of every fourth view, as far as there are, in their order; it may cross itself."""
    return _views(spark, d).where("view % 4 = 0").select("flight_id", "view", "x", "y")


def path_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Corners, area and length around of each flight's polygon."""
    a = polygon_areas(_path_polygons(spark, d), BY, "view")
    return a.select("flight_id", "n", steady(F.col("area"), 2).alias("area"), steady(F.col("length"), 2).alias("length"))


def cells_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Surface cells whose middle lies in their flight's polygon, and their mean height."""
    box = points(spark, d).groupBy("flight_id").agg(F.min("x").alias("x_min"), F.max("y").alias("y_max"))
    c = grid_dsm(spark, d).join(box, BY).select("flight_id", "z", (F.col("x_min") + (F.col("col") + 0.5) * RES).alias("x"), (F.col("y_max") - (F.col("row") + 0.5) * RES).alias("y"))
    return inside(c, _path_polygons(spark, d), BY, "view", 50.0).groupBy("flight_id").agg(F.count("*").alias("cells"), steady(F.avg("z"), 4).alias("z"))


def point_tsdf(spark: SparkSession, d: str) -> DataFrame:
    """Truncated signed height over the points around each voxel's middle, weighted by confidence and nearness.

    A point is offered to the voxels within reach, a fixed number; inferred points (tier 0) weigh nothing.
    """
    v = {f"i{a}": voxel(a, TSDF_VOXEL) for a in "xyz"}
    p = points(spark, d).where("tier > 0").withColumns(v).withColumn("o", F.explode(_offsets(2, "ijk")))
    p = p.select("flight_id", "x", "y", "z", "tier", *[(F.col(f"i{a}") + F.col(f"o.{s}")).alias(f"i{a}") for a, s in zip("xyz", "ijk")])
    mid = {a: (F.col(f"i{a}") + 0.5) * TSDF_VOXEL for a in "xyz"}
    dist = F.sqrt(sum((F.pow(mid[a] - F.col(a), 2) for a in "xyz"), F.lit(0.0)))
    p = p.withColumns({"d": dist, "sdf": mid["z"] - F.col("z")}).where(F.col("d") < SPLAT).withColumn("w", F.col("tier") * (1 - F.col("d") / SPLAT))
    g = p.groupBy("flight_id", *v).agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("sdf")) / F.sum("w")).alias("s"), F.count("*").alias("n"))
    return g.where("w > 0.01").select("flight_id", *v, steady(F.least(F.lit(TRUNC), F.greatest(F.lit(-TRUNC), F.col("s"))), 4).alias("sdf"), "n")


_BLOCKS = """b AS (SELECT a.flight_id, a.row AS r, a.col AS c FROM dsm a JOIN dsm b ON b.flight_id = a.flight_id AND b.row = a.row AND b.col = a.col + 1 JOIN dsm c ON c.flight_id = a.flight_id AND c.row = a.row + 1 AND c.col = a.col JOIN dsm e ON e.flight_id = a.flight_id AND e.row = a.row + 1 AND e.col = a.col + 1)"""
_CENTRES = f"""centre AS (SELECT flight_id, concat_ws(':', CAST(floor(x / 2.0) AS BIGINT), CAST(floor(y / 2.0) AS BIGINT), CAST(floor(z / 2.0) AS BIGINT)) AS id, {', '.join(f"{steady_sql(f'avg({a})', 3)} AS {a}" for a in 'xyz')} FROM point GROUP BY flight_id, floor(x / 2.0), floor(y / 2.0), floor(z / 2.0))"""
_D3 = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"

SQL = {
    "mesh_watertight": f"""WITH {_DSM}, {_BLOCKS}, e AS (SELECT flight_id, r AS r1, c AS c1, r AS r2, c + 1 AS c2 FROM b UNION ALL SELECT flight_id, r, c, r + 1, c FROM b UNION ALL SELECT flight_id, r + 1, c, r + 1, c + 1 FROM b UNION ALL SELECT flight_id, r, c + 1, r + 1, c + 1 FROM b UNION ALL SELECT flight_id, r, c + 1, r + 1, c FROM b UNION ALL SELECT flight_id, r, c + 1, r + 1, c FROM b),
n AS (SELECT flight_id, count(*) AS n FROM e GROUP BY flight_id, r1, c1, r2, c2) SELECT flight_id, count(*) AS edges, count(*) FILTER (n <> 2) AS open_edges, count(*) FILTER (n <> 2) = 0 AS watertight FROM n GROUP BY flight_id""",
    "compact_vertices": f"""WITH {_DSM}, {_BLOCKS}, u AS (SELECT DISTINCT flight_id, r + i AS row, c + j AS col FROM b, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)) SELECT d.flight_id, count(u.row) AS used, count(*) - count(u.row) AS unused FROM dsm d LEFT JOIN u ON u.flight_id = d.flight_id AND u.row = d.row AND u.col = d.col GROUP BY d.flight_id""",
    "knn_outlier_removal": f"""WITH {POINTS}, {_CENTRES}, n AS (SELECT a.flight_id, a.id AS pid, {steady_sql(_D3, 4)} AS d, b.id FROM centre a JOIN centre b ON b.flight_id = a.flight_id AND b.id <> a.id AND b.x BETWEEN a.x - {REACH} AND a.x + {REACH}), r AS (SELECT *, row_number() OVER (PARTITION BY flight_id, pid ORDER BY d, id) AS r FROM n WHERE d < {REACH}),
s AS (SELECT flight_id, pid, sum(d) AS s, count(*) AS n FROM r WHERE r <= {K} GROUP BY ALL), m AS (SELECT c.flight_id, c.id, {steady_sql(f'(coalesce(s, 0.0) + ({K} - coalesce(n, 0)) * {REACH}) / {K}', 4)} AS m FROM centre c LEFT JOIN s ON s.flight_id = c.flight_id AND s.pid = c.id)
SELECT flight_id, id, m FROM m JOIN (SELECT flight_id, {steady_sql(f'avg(m) + {SIGMAS} * stddev_pop(m)', 4)} AS lim FROM m GROUP BY ALL) USING (flight_id) WHERE m <= lim""",
    "check_point_residuals": f"""WITH {_V}, {_CENTRES}, j AS (SELECT b.flight_id, b.view, {steady_sql(_D3, 4)} AS d, a.id, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS h2, a.z - b.z AS dz FROM v b JOIN centre a ON a.flight_id = b.flight_id AND a.x BETWEEN b.x - 4.1 AND b.x + 4.1),
n AS (SELECT * FROM j WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY flight_id, view ORDER BY d, id) = 1) SELECT flight_id, count(*) AS n, {steady_sql('sqrt(avg(h2))', 4)} AS rmse_h, {steady_sql('avg(dz)', 4)} AS bias_v FROM n GROUP BY flight_id""",
    "bilinear_sample": f"""WITH {_DSM}, v AS (SELECT flight_id, view, {', '.join(f"{steady_sql(f'avg({a})', 3)} AS {a}" for a in 'xyz')} FROM point GROUP BY ALL), q AS (SELECT flight_id, view, (x - x_min) / {RES} - 0.5 AS u, (y_max - y) / {RES} - 0.5 AS w FROM v JOIN box USING (flight_id)),
a AS (SELECT *, i, j, floor(w) + i AS row, floor(u) + j AS col FROM q, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
s AS (SELECT a.flight_id, view, count(z) AS n, sum(z * (CASE WHEN i = 1 THEN w - floor(w) ELSE 1 - (w - floor(w)) END) * (CASE WHEN j = 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END)) AS mix, max(CASE WHEN a.row = floor(w + 0.5) AND a.col = floor(u + 0.5) THEN z END) AS own
  FROM a LEFT JOIN dsm d ON d.flight_id = a.flight_id AND d.row = a.row AND d.col = a.col GROUP BY ALL) SELECT flight_id, view, {steady_sql('CASE WHEN n = 4 THEN mix ELSE own END', 4)} AS z, CAST(n AS INTEGER) AS known FROM s""",
    "path_polygons": f"""WITH {_V}, c AS (SELECT * FROM v WHERE view % 4 = 0), e AS (SELECT flight_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER u) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER u) AS y2 FROM c WINDOW w AS (PARTITION BY flight_id ORDER BY view), u AS (PARTITION BY flight_id ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT flight_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN {steady_sql('abs(sum(x * y2 - y * x2)) / 2', 2)} ELSE 0.0 END AS area, CASE WHEN count(*) >= 3 THEN {steady_sql('sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2))', 2)} ELSE 0.0 END AS length FROM e GROUP BY flight_id""",
    "cells_in_polygon": f"""WITH {_DSM}, v AS (SELECT flight_id, view, {', '.join(f"{steady_sql(f'avg({a})', 3)} AS {a}" for a in 'xy')} FROM point GROUP BY ALL), c AS (SELECT * FROM v WHERE view % 4 = 0),
e AS (SELECT flight_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER u) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER u) AS y2, count(*) OVER u AS n FROM c WINDOW w AS (PARTITION BY flight_id ORDER BY view), u AS (PARTITION BY flight_id ORDER BY view ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT flight_id, row, col, z, x_min + (col + 0.5) * {RES} AS x, y_max - (row + 0.5) * {RES} AS y FROM dsm JOIN box USING (flight_id)),
h AS (SELECT q.flight_id, row, col, any_value(q.z) AS z, count(*) AS k FROM q JOIN e ON e.flight_id = q.flight_id AND e.n >= 3 AND (e.y > q.y) <> (e.y2 > q.y) AND q.x >= e.x + (q.y - e.y) / (e.y2 - e.y) * (e.x2 - e.x) GROUP BY ALL) SELECT flight_id, count(*) AS cells, {steady_sql('avg(z)', 4)} AS z FROM h WHERE k % 2 = 1 GROUP BY flight_id""",
    "point_tsdf": f"""WITH {POINTS}, o AS (SELECT flight_id, x, y, z, tier, {', '.join(f'CAST(floor({a} / {TSDF_VOXEL}) AS BIGINT) + {s} AS i{a}' for a, s in zip('xyz', 'ijk'))} FROM point, range(-2, 3) p(i), range(-2, 3) q(j), range(-2, 3) r(k) WHERE tier > 0),
d AS (SELECT *, sqrt({' + '.join(f'((i{a} + 0.5) * {TSDF_VOXEL} - {a}) ** 2' for a in 'xyz')}) AS d, (iz + 0.5) * {TSDF_VOXEL} - z AS sdf FROM o), w AS (SELECT *, tier * (1 - d / {SPLAT}) AS w FROM d WHERE d < {SPLAT}),
g AS (SELECT flight_id, ix, iy, iz, sum(w) AS w, sum(w * sdf) / sum(w) AS s, count(*) AS n FROM w GROUP BY ALL) SELECT flight_id, ix, iy, iz, {steady_sql(f'least({TRUNC}, greatest(-{TRUNC}, s))', 4)} AS sdf, n FROM g WHERE w > 0.01""",
}
QUERIES = {name: globals()[name] for name in SQL}
