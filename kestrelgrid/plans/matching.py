"""Matches between vectors, tracks over observations and meshes as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.operators.components import components
from kestrelgrid.operators.vector_search import count_within, nearest
from kestrelgrid.plans.points import POINTS
from kestrelgrid.plans.surface import _DSM, grid_dsm
from kestrelgrid.sources.tables import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return _vectors(spark, d).where(F.pmod("id", F.lit(100)) == 0)


def nearest_transfer(spark: SparkSession, d: str) -> DataFrame:
    """The nearest other vector of each query, and its label."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return nearest(_vectors(spark, d), _asked(spark, d), 1).join(labels, "id").select("q", F.col("id").alias("nn"), F.round("d", 4).alias("d"), "label")


def topk_sources(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of each query."""
    return nearest(_vectors(spark, d), _asked(spark, d), 5).select("q", "id", F.col("rank").cast("bigint").alias("rank"))


def descriptor_ratio_mutual(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose nearest is clearly nearer than the next, and whose nearest finds them in turn."""
    two = nearest(_vectors(spark, d), _asked(spark, d), 2).groupBy("q").agg(F.min(F.struct("rank", "id", "d")).alias("a"), F.max(F.struct("rank", "d")).alias("b"))
    forward = two.where((F.col("b.rank") == 2) & (F.round("a.d", 6) < 0.95 * F.col("b.d"))).select("q", F.col("a.id").alias("t"))
    back = nearest(_vectors(spark, d), _vectors(spark, d).join(forward.select(F.col("t").alias("id")).distinct(), "id", "left_semi"), 1).select(F.col("q").alias("t"), F.col("id").alias("q"))
    return forward.join(back, ["q", "t"])


def radius_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many others lie within 1.2 of each query."""
    return count_within(_vectors(spark, d), _asked(spark, d), 1.2)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as observations: the order is the track, the supplier the camera."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_suppkey").alias("camera")).distinct()


def track_filter(spark: SparkSession, d: str) -> DataFrame:
    """Tracks seen by at least three cameras."""
    return _observations(spark, d).groupBy("track").agg(F.count("*").alias("len")).where("len >= 3")


def tracks_without_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Tracks left with two cameras or more when those with the most negative balance are gone."""
    gone = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("camera"))
    return _observations(spark, d).join(gone, "camera", "left_anti").groupBy("track").agg(F.count("*").alias("len")).where("len >= 2")


def track_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean, median and largest length of the tracks, and the share of cameras with fewer than five."""
    o = _observations(spark, d)
    n = o.groupBy("track").agg(F.count("*").alias("len")).groupBy("len").agg(F.count("*").alias("n"))
    t = n.agg(F.sum("n").alias("tracks"), F.round(F.sum(F.col("len") * F.col("n")) / F.sum("n"), 6).alias("mean_len"), F.percentile("len", F.lit(0.5), F.col("n")).alias("median_len"), F.max("len").alias("max_len"))
    cams = table(spark, d, "supplier").select(F.col("s_suppkey").alias("camera")).join(o.groupBy("camera").agg(F.count("*").alias("n")), "camera", "left")
    c = cams.agg(F.round(F.avg(F.when(F.coalesce("n", F.lit(0)) < 5, 1.0).otherwise(0.0)), 6).alias("thin_cameras"))
    return t.join(F.broadcast(c))  # one row each


def observation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the fixes above their flight's first, and whether it passes at 99 %; per flight kind."""
    from kestrelgrid.plans.points import points

    kind = table(spark, d, "flights").select("flight_id", "log_kind").distinct()
    p = points(spark, d).join(kind, "flight_id").groupBy("log_kind").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("z") > -30, 1.0).otherwise(0.0)), 6).alias("share"))
    return p.withColumn("passed", F.col("share") >= 0.99)


def mesh_edges(spark: SparkSession, d: str) -> DataFrame:
    """Neighbouring cells of the surface whose heights differ by at most 3 m, by number."""
    c = grid_dsm(spark, d).select("flight_id", "row", "col", "z", F.xxhash64("flight_id", "row", "col").alias("v"))
    o = c.withColumn("o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (1, 1), (1, -1))])))
    o = o.select("flight_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.col("z").alias("za"), F.col("v").alias("a"))
    return o.join(c, ["flight_id", "row", "col"]).where(F.round(F.abs(F.col("z") - F.col("za")), 3) <= 3).select("a", F.col("v").alias("b"))


def surface_components(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of surface that hang together, and their sizes, of each flight; lone cells are no piece."""
    cells = grid_dsm(spark, d).select("flight_id", F.xxhash64("flight_id", "row", "col").alias("v"))
    c = components(mesh_edges(spark, d)).join(cells, "v").groupBy("flight_id", "component").agg(F.count("*").alias("n"))
    return c.groupBy("flight_id").agg(F.count("*").alias("pieces"), F.sum("n").alias("cells"), F.max("n").alias("largest"))


def cluster_decimate(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the surface merged into clusters of 3 x 3: mean height, lowest row first."""
    from kestrelgrid.functions.rounding import steady

    q = {f"q{a}": F.floor(F.col(a) / 3).cast("bigint") for a in ("row", "col")}
    return grid_dsm(spark, d).withColumns(q).groupBy("flight_id", *q).agg(steady(F.avg("z"), 4).alias("z"), F.count("*").alias("n"))


_BASE = "v AS (SELECT vec_id AS id, embedding AS e FROM embeddings)"
_NEAR = f"""{_BASE}, d AS (SELECT a.id AS q, b.id, round(list_distance(a.e, b.e)::DOUBLE, 6) AS d FROM v a JOIN v b ON a.id % 100 = 0 AND b.id <> a.id), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS rank FROM d)"""
_EXACT = _NEAR.replace("round(list_distance(a.e, b.e)::DOUBLE, 6)", "round(list_distance(a.e::DOUBLE[], b.e::DOUBLE[]), 6)")
_OBS = "o AS (SELECT DISTINCT l_orderkey AS track, l_suppkey AS camera FROM lineitem)"

SQL = {
    "nearest_transfer": f"WITH {_EXACT} SELECT q, r.id AS nn, round(d, 4) AS d, label FROM r JOIN embeddings ON vec_id = r.id WHERE rank = 1",
    "topk_sources": f"WITH {_EXACT} SELECT q, id, rank FROM r WHERE rank <= 5",
    "descriptor_ratio_mutual": f"""WITH {_EXACT}, f AS (SELECT a.q, a.id AS t FROM r a JOIN r b ON b.q = a.q AND a.rank = 1 AND b.rank = 2 WHERE a.d < 0.95 * b.d),
b AS (SELECT x.id AS t, y.id AS q FROM v x JOIN v y ON y.id <> x.id WHERE x.id IN (SELECT t FROM f) QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY round(list_distance(x.e::DOUBLE[], y.e::DOUBLE[]), 6), y.id) = 1) SELECT q, t FROM f JOIN b USING (q, t)""",
    "radius_pairs": f"WITH {_EXACT} SELECT q, count(*) AS n FROM d WHERE d <= 1.2 GROUP BY q",
    "track_filter": f"WITH {_OBS} SELECT track, count(*) AS len FROM o GROUP BY track HAVING count(*) >= 3",
    "tracks_without_cameras": f"WITH {_OBS} SELECT track, count(*) AS len FROM o WHERE camera NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY track HAVING count(*) >= 2",
    "track_statistics": f"""WITH {_OBS}, t AS (SELECT track, count(*) AS len FROM o GROUP BY track), c AS (SELECT s_suppkey, count(camera) AS n FROM supplier LEFT JOIN o ON camera = s_suppkey GROUP BY s_suppkey)
SELECT count(*) AS tracks, round(avg(len), 6) AS mean_len, quantile_cont(len, 0.5) AS median_len, max(len) AS max_len, (SELECT round(avg(CASE WHEN n < 5 THEN 1.0 ELSE 0.0 END), 6) FROM c) AS thin_cameras FROM t""",
    "observation_gate": f"WITH {POINTS}, r AS (SELECT log_kind, count(*) AS n, round(avg(CASE WHEN z > -30 THEN 1.0 ELSE 0.0 END), 6) AS share FROM point JOIN (SELECT DISTINCT flight_id, log_kind FROM flights) USING (flight_id) GROUP BY log_kind) SELECT *, share >= 0.99 AS passed FROM r",
    "surface_components": f"""WITH RECURSIVE {_DSM}, c AS (SELECT flight_id, row, col, z, row * 1000000 + col AS v FROM dsm), e AS (SELECT a.flight_id, a.v AS a, b.v AS b FROM c a JOIN c b ON b.flight_id = a.flight_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.v <> a.v AND round(abs(a.z - b.z), 3) <= 3),
reach(flight_id, v, r) AS (SELECT DISTINCT flight_id, a, a FROM e UNION SELECT e.flight_id, e.b, reach.r FROM reach JOIN e ON e.flight_id = reach.flight_id AND e.a = reach.v AND reach.r < e.b), m AS (SELECT flight_id, v, min(r) AS r FROM reach GROUP BY ALL), s AS (SELECT flight_id, r, count(*) AS n FROM m GROUP BY ALL)
SELECT flight_id, count(*) AS pieces, CAST(sum(n) AS BIGINT) AS cells, max(n) AS largest FROM s GROUP BY flight_id""",
    "cluster_decimate": f"WITH {_DSM} SELECT flight_id, CAST(floor(row / 3) AS BIGINT) AS qrow, CAST(floor(col / 3) AS BIGINT) AS qcol, floor(avg(z) * 10000 + 0.500001) / 10000 AS z, count(*) AS n FROM dsm GROUP BY flight_id, floor(row / 3), floor(col / 3)",
}
QUERIES = {name: globals()[name] for name in SQL}
