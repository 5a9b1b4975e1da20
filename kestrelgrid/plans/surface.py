"""Grid, voxel and surface queries over the telemetry points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelgrid.functions.rounding import steady, steady_sql
from kestrelgrid.operators.coverage import box_depths
from kestrelgrid.operators.grid import consensus, counted_median, fill_nearest, nearest_rank, radius_outliers, raster_cells, voxel
from kestrelgrid.plans.points import POINTS, points

BY, CELL, RES = ["flight_id"], ["flight_id", "row", "col"], 5.0


def _mm() -> F.Column:
    return F.round(F.col("z") * 1000).cast("bigint")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return raster_cells(points(spark, d), BY, RES)


def grid_dsm(spark: SparkSession, d: str) -> DataFrame:
    """Highest point of each cell."""
    return _grid(spark, d).groupBy(*CELL).agg(F.max("z").alias("z"), F.count("*").alias("n"))


def grid_confidence_min(spark: SparkSession, d: str) -> DataFrame:
    """Lowest confidence of each cell."""
    return _grid(spark, d).groupBy(*CELL).agg(F.min("tier").alias("tier"))


def grid_ortho_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The sample on top of each cell, the smaller id of equals, and its heading."""
    top = F.max(F.struct("z", (-F.col("sample_id")).alias("k"), "yaw")).alias("t")
    return _grid(spark, d).groupBy(*CELL).agg(top).select(*CELL, (-F.col("t.k")).alias("sample_id"), F.col("t.yaw").alias("yaw"))


def voxel_downsample(spark: SparkSession, d: str) -> DataFrame:
    """Mean position and lowest confidence of each voxel of 2 m."""
    v = {f"i{a}": voxel(a, 2.0) for a in "xyz"}
    return points(spark, d).withColumns(v).groupBy("flight_id", *v).agg(*[steady(F.avg(a), 4).alias(a) for a in "xyz"], F.count("*").alias("n"), F.min("tier").alias("tier"))


def point_dedup_eps(spark: SparkSession, d: str) -> DataFrame:
    """Points that round to one place of 5 cm, as one: mean position, lowest confidence and label."""
    q = {f"q{a}": F.rint(F.col(a) / 0.05).cast("bigint") for a in "xyz"}
    return points(spark, d).withColumns(q).groupBy("flight_id", *q).agg(*[steady(F.avg(a), 4).alias(a) for a in "xyz"], F.count("*").alias("n"), F.min("tier").alias("tier"), F.min("label").alias("label"))


def view_bitmask_count(spark: SparkSession, d: str) -> DataFrame:
    """Views that see each voxel of 10 m, as bits of a word of 64, and the confidence they give."""
    v = {f"i{a}": voxel(a, 10.0) for a in "xyz"}
    bit = F.expr("shiftleft(1L, CAST(pmod(view, 64) AS INT))")
    n = points(spark, d).withColumns(v).groupBy("flight_id", *v).agg(F.bit_count(F.bit_or(bit)).cast("int").alias("views"))
    return n.withColumn("tier", F.when(F.col("views") >= 3, 2).when(F.col("views") == 2, 1).otherwise(0))


def consensus_height(spark: SparkSession, d: str) -> DataFrame:
    """Height by vote: each view's weighted mean is a vote, votes within half a metre agree."""
    w = 1 / (1 + F.coalesce("acc", F.lit(2.0)) * F.coalesce("acc", F.lit(2.0)))
    v = _grid(spark, d).withColumn("w", w).where("w > 0").groupBy(*CELL, "view").agg(steady(F.sum(F.col("z") * F.col("w")) / F.sum("w") * 1000, 0).cast("bigint").alias("z"))
    c = consensus(v, CELL, 500)
    return c.select(*CELL, steady(F.col("z_mean") / 1000, 4).alias("z"), "n_agree", F.when(F.col("n_agree") >= 3, 2).when(F.col("n_agree") == 2, 1).otherwise(0).alias("tier"))


def heightmap_mesh_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of 2 x 2 known cells whose heights differ by at most 3 m; each cell is offered to the four blocks it is in."""
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    c = grid_dsm(spark, d).withColumn("o", o).select("flight_id", (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), "z")
    b = c.groupBy(*CELL).agg(F.count("*").alias("n"), F.round(F.max("z") - F.min("z"), 3).alias("span"))
    return b.where("n = 4 AND span <= 3").select(*CELL, "span")


def cell_percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    """Fifth and ninety-fifth percentile of the heights of each cell, in mm."""
    r = nearest_rank(_grid(spark, d).withColumn("mm", _mm()), CELL, "mm", {"p5": 5, "p95": 95}, least=3)
    return r.withColumn("span", F.col("p95") - F.col("p5"))


def flat_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of at least 5 points whose heights span at most 1.5 m, or at most the quarter of spans where that is more."""
    c = _grid(spark, d).groupBy(*CELL).agg(F.count("*").alias("n"), F.round((F.max("z") - F.min("z")) * 1000).cast("bigint").alias("span")).where("n >= 5")
    q = counted_median(c, BY, "span", 0.25)
    return c.join(q, BY).where(F.col("span") <= F.greatest(F.lit(1500.0), F.col("m"))).select(*CELL, "span")


def overlap_disagreement(spark: SparkSession, d: str) -> DataFrame:
    """How far the views' median heights of a cell differ: median and ninetieth percentile over cells seen twice or more."""
    v = _grid(spark, d).withColumn("mm", _mm()).groupBy(*CELL, "view").agg(F.percentile("mm", F.lit(0.5)).alias("m"), F.count("*").alias("n")).where("n >= 3")
    c = v.groupBy(*CELL).agg(F.count("*").alias("views"), F.round(F.max("m") - F.min("m")).cast("bigint").alias("range")).where("views >= 2")
    n = c.groupBy("flight_id", "range").agg(F.count("*").alias("n"))
    return n.groupBy("flight_id").agg(F.sum("n").alias("cells"), *[F.round(F.percentile("range", F.lit(p), F.col("n")), 3).alias(k) for k, p in (("median_mm", 0.5), ("p90_mm", 0.9))])


def reference_ground_error(spark: SparkSession, d: str) -> DataFrame:
    """Of each 5 minutes of a flight the median difference of its ground (10 % of the heights of a cell) from the whole flight's."""
    g = _grid(spark, d).withColumn("mm", _mm()).withColumn("part", F.floor(F.col("view") / 15).cast("bigint"))
    own = nearest_rank(g, [*CELL, "part"], "mm", {"own": 10}, least=5).drop("n")
    whole = nearest_rank(g, CELL, "mm", {"ground": 10}, least=10).drop("n")
    e = own.join(whole, CELL).withColumn("e", F.col("own") - F.col("ground"))
    return counted_median(e, ["flight_id", "part"], "e").select("flight_id", "part", F.round("m", 2).alias("error_mm"))


def placement_verdict(spark: SparkSession, d: str) -> DataFrame:
    """PASS or FAIL by the views' disagreement, UNMEASURED where too few cells overlap; missing evidence never passes."""
    flights = points(spark, d).select("flight_id").distinct()
    r = flights.join(overlap_disagreement(spark, d), "flight_id", "left")
    verdict = F.when(F.coalesce("cells", F.lit(0)) < 3, "UNMEASURED").when((F.col("median_mm") > 1000) | (F.col("p90_mm") > 5000), "FAIL").otherwise("PASS")
    return r.select("flight_id", F.coalesce("cells", F.lit(0)).alias("cells"), verdict.alias("verdict"))


def dtm_min_ground(spark: SparkSession, d: str) -> DataFrame:
    """Lowest ground point of each cell; points of class 2 are ground where they are 2 % of a flight, else all are."""
    g = _grid(spark, d)
    share = g.groupBy("flight_id").agg((F.avg(F.when(F.col("label") == 2, 1.0).otherwise(0.0)) >= 0.02).alias("classed"))
    return g.join(share, BY).where(~F.col("classed") | (F.col("label") == 2)).groupBy(*CELL).agg(F.min("z").alias("z"))


def height_above_ground(spark: SparkSession, d: str) -> DataFrame:
    """Surface minus ground, never below 0, where both are known."""
    s, g = grid_dsm(spark, d), dtm_min_ground(spark, d).withColumnRenamed("z", "g")
    return s.join(g, CELL).select(*CELL, F.greatest(F.lit(0.0), F.round(F.col("z") - F.col("g"), 3)).alias("h"))


def ground_z(spark: SparkSession, d: str) -> DataFrame:
    """Ground height of each flight: the median of height less height above take-off, in mm."""
    p = points(spark, d).where("alt_rel IS NOT NULL").withColumn("g", F.round((F.col("z") - F.col("alt_rel")) * 1000).cast("bigint"))
    return counted_median(p, BY, "g").select("flight_id", F.round("m", 1).alias("ground_mm"))


def ground_band_filter(spark: SparkSession, d: str) -> DataFrame:
    """Points from 60 m below to 80 m above the ground; all points of a flight where that would turn away over a quarter."""
    p = points(spark, d).join(ground_z(spark, d), BY)
    inside = F.col("z").between(F.col("ground_mm") / 1000 - 60, F.col("ground_mm") / 1000 + 80)
    share = p.groupBy("flight_id").agg((F.avg(F.when(inside, 0.0).otherwise(1.0)) > 0.25).alias("declined"))
    return p.withColumn("inside", inside).join(share, BY).where("declined OR inside").select("flight_id", "sample_id")


def crop_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Points of a box that is open above."""
    return points(spark, d).where(F.col("x").between(-150, 150) & F.col("y").between(-150, 150) & (F.col("z") >= -20)).select("flight_id", "sample_id")


def confidence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Points of low confidence or better."""
    return points(spark, d).where("tier >= 1").select("flight_id", "sample_id", "tier")


def hole_fill_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Surface with holes within 6 cells filled from the nearest known cell."""
    return fill_nearest(grid_dsm(spark, d).select(*CELL, "z"), BY, "z", 6)


def occupied_area(spark: SparkSession, d: str) -> DataFrame:
    """Area of the cells with a point, and the median of the relief inside cells of at least 5 points."""
    c = _grid(spark, d).groupBy(*CELL).agg(F.count("*").alias("n"), F.round((F.max("z") - F.min("z")) * 1000).cast("bigint").alias("span"))
    a = c.groupBy("flight_id").agg((F.count("*") * RES * RES).alias("area_m2"))
    return a.join(counted_median(c.where("n >= 5"), BY, "span").withColumnRenamed("m", "relief_mm"), BY, "left")


def uncertainty_summary(spark: SparkSession, d: str) -> DataFrame:
    """Median and ninetieth percentile of the accuracies, and the shares within 0.5 m and 1 m."""
    p = points(spark, d).where("acc > 0").withColumn("mm", F.round(F.col("acc") * 1000).cast("bigint"))
    n = p.groupBy("flight_id", "mm").agg(F.count("*").alias("n"))
    share = lambda m: F.round(F.sum(F.when(F.col("mm") <= m, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    return n.groupBy("flight_id").agg(*[F.round(F.percentile("mm", F.lit(q), F.col("n")), 3).alias(k) for k, q in (("median_mm", 0.5), ("p90_mm", 0.9))], share(500).alias("within_05"), share(1000).alias("within_1"))


def auto_voxel_size(spark: SparkSession, d: str) -> DataFrame:
    """A two-hundredth of the largest extent, between 5 cm and 5 m, and a raster's resolution for 512 cells."""
    e = points(spark, d).groupBy("flight_id").agg(F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("e"))
    return e.select("flight_id", F.round(F.least(F.lit(5.0), F.greatest(F.lit(0.05), F.col("e") / 200)), 6).alias("voxel_m"), F.round(F.greatest(F.lit(0.01), F.col("e") / 512), 6).alias("res_m"))


def radius_outlier_removal(spark: SparkSession, d: str) -> DataFrame:
    """Points with at least 4 others within 6 m."""
    return radius_outliers(points(spark, d), BY, "sample_id", 6.0, 4)


def zbuffer_visible(spark: SparkSession, d: str) -> DataFrame:
    """Points within half a metre of the one nearest from above in each view and block of 4 m."""
    b = {f"i{a}": voxel(a, 4.0) for a in "xy"}
    p = points(spark, d).withColumns(b)
    top = p.groupBy("flight_id", "view", *b).agg(F.max("z").alias("top"))
    return p.join(top, ["flight_id", "view", *b]).where(F.col("z") >= F.round(F.col("top") - 0.5, 3)).select("flight_id", "view", "sample_id")


def weighted_label_vote(spark: SparkSession, d: str) -> DataFrame:
    """Label of each cell by weighted votes; 0 with a reason where views, share or weight are too little."""
    conf = 1 / (1 + F.coalesce("acc", F.lit(2.0)))
    dist = F.greatest(F.lit(1.0), F.abs(F.coalesce("alt_rel", "z")))
    incidence = F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.abs(F.sin(F.radians(F.coalesce("pitch", F.lit(-90.0)))))))
    p = _grid(spark, d).where("label > 0").withColumn("w", conf * F.least(F.pow(40 / dist, 2), F.lit(4.0)) * incidence)
    v = p.groupBy(*CELL, "label").agg(F.sum("w").alias("w"))
    views = p.groupBy(*CELL, "view").agg(F.lit(1).alias("one")).groupBy(*CELL).agg(F.count("*").alias("views"))
    best = v.groupBy(*CELL).agg(F.max(F.struct(F.round("w", 9).alias("w"), (-F.col("label")).alias("k"))).alias("b"), F.sum("w").alias("total")).join(views, CELL)
    ratio = F.col("b.w") / F.col("total")
    reason = F.when(F.col("views") < 2, "few_views").when(F.col("total") <= 0, "no_weight").when(steady(ratio, 6) < 0.6, "split_vote").otherwise("ok")
    return best.select(*CELL, F.when(reason == "ok", -F.col("b.k")).otherwise(0).alias("label"), steady(ratio, 5).alias("ratio"), "views", reason.alias("reason"))


def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Share of each label that occurs in a flight, in percent; labels that don't occur have no row."""
    n = points(spark, d).groupBy("flight_id", "label").agg(F.count("*").alias("n"))
    whole = n.groupBy("flight_id").agg(F.sum("n").alias("whole"))
    return n.join(whole, BY).select("flight_id", "label", F.round(F.col("n") * 100 / F.col("whole"), 2).alias("pct"))


def vertical_profile(spark: SparkSession, d: str) -> DataFrame:
    """Triangles of the height map: two for each block, with area in plan and in space, and lowest confidence."""
    c = grid_dsm(spark, d).join(grid_confidence_min(spark, d), CELL)
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    e = c.withColumn("o", o).select("flight_id", (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), (F.col("o.i") * 2 + F.col("o.j")).alias("corner"), "z", "tier")
    b = e.groupBy(*CELL).agg(*[F.max(F.when(F.col("corner") == k, F.col("z"))).alias(f"z{k}") for k in range(4)], F.min("tier").alias("tier"), F.count("*").alias("n")).where("n = 4")

    def area(p: str, a: str, b_: str) -> F.Column:
        u, v = F.col(a) - F.col(p), F.col(b_) - F.col(p)
        return F.sqrt(F.pow(u * RES, 2) + F.pow(v * RES, 2) + F.lit(RES**4)) / 2

    t = b.withColumns({"a1": area("z0", "z1", "z2"), "a2": area("z3", "z1", "z2")})
    return t.groupBy("flight_id").agg((F.count("*") * 2).alias("triangles"), F.round(F.count("*") * RES * RES, 3).alias("plan_m2"), F.round(F.sum(F.col("a1") + F.col("a2")), 3).alias("area_m2"), *[F.round(F.avg(F.when(F.col("tier") == k, 1.0).otherwise(0.0)) * 100, 2).alias(f"pct{k}") for k in (0, 1, 2)])


def cut_fill_volume(spark: SparkSession, d: str) -> DataFrame:
    """Volume above and below each flight's least-squares plane through its surface cells."""
    c = grid_dsm(spark, d).withColumns({"u": F.col("col") * RES, "v": -F.col("row") * RES})
    m = c.groupBy("flight_id").agg(F.avg("u").alias("mu"), F.avg("v").alias("mv"), F.avg("z").alias("mz"), F.covar_pop("u", "u").alias("suu"), F.covar_pop("v", "v").alias("svv"), F.covar_pop("u", "v").alias("suv"), F.covar_pop("u", "z").alias("suz"), F.covar_pop("v", "z").alias("svz"))
    det = F.col("suu") * F.col("svv") - F.col("suv") * F.col("suv")
    m = m.withColumns({"a": F.when(det > 1e-6, (F.col("suz") * F.col("svv") - F.col("svz") * F.col("suv")) / det), "b": F.when(det > 1e-6, (F.col("svz") * F.col("suu") - F.col("suz") * F.col("suv")) / det)})
    dz = F.col("z") - (F.col("mz") + F.col("a") * (F.col("u") - F.col("mu")) + F.col("b") * (F.col("v") - F.col("mv")))
    r = c.join(m, BY).where("a IS NOT NULL").withColumn("dz", dz)
    return r.groupBy("flight_id").agg(F.round(F.sum(F.greatest(F.col("dz"), F.lit(0.0))) * RES * RES, 2).alias("above_m3"), F.round(-F.sum(F.least(F.col("dz"), F.lit(0.0))) * RES * RES, 2).alias("below_m3"), F.count("*").alias("cells"))


def elevation_profile(spark: SparkSession, d: str) -> DataFrame:
    """Surface along the middle row of each flight: bilinear height every 2.5 m, where the four cells around are known."""
    c = grid_dsm(spark, d)
    mid = c.groupBy("flight_id").agg(F.floor(F.max("row") / 2).cast("bigint").alias("mid"))
    r = c.join(mid, BY).where((F.col("row") == F.col("mid")) | (F.col("row") == F.col("mid") + 1))
    n = r.groupBy("flight_id", "col").agg(F.avg("z").alias("z"), F.count("*").alias("n")).where("n = 2")
    o = n.withColumn("o", F.explode(F.array(F.lit(0), F.lit(1)))).select("flight_id", (F.col("col") - F.col("o")).alias("col"), "o", "z")
    pair = o.groupBy("flight_id", "col").agg(F.max(F.when(F.col("o") == 0, F.col("z"))).alias("a"), F.max(F.when(F.col("o") == 1, F.col("z"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    s = pair.withColumn("k", F.explode(F.array(F.lit(0.0), F.lit(0.5))))
    return s.select("flight_id", ((F.col("col") + F.col("k")) * RES).alias("d_m"), steady(F.col("a") + (F.col("b") - F.col("a")) * F.col("k"), 4).alias("z"))


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 10 m that the views' bounding boxes cover, how often at median and least, and the share seen once."""
    v = points(spark, d).groupBy("flight_id", "view").agg(*[F.floor(f(a) / 10).cast("bigint").alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    return box_depths(v).groupBy("flight_id").agg(F.sum("n").alias("cells"), F.percentile("seen", F.lit(0.5), F.col("n")).alias("median_seen"), F.min("seen").alias("least_seen"), F.round(F.sum(F.when(F.col("seen") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("seen_once"))


_GRID = f"""{POINTS}, box AS (SELECT flight_id, min(x) AS x_min, max(y) AS y_max, greatest(1, ceil((max(x) - min(x)) / {RES})) AS n_cols, greatest(1, ceil((max(y) - min(y)) / {RES})) AS n_rows FROM point GROUP BY flight_id),
grid AS (SELECT p.*, CAST(least(floor((y_max - y) / {RES}), n_rows - 1) AS BIGINT) AS row, CAST(least(floor((x - x_min) / {RES}), n_cols - 1) AS BIGINT) AS col, CAST(round(z * 1000) AS BIGINT) AS mm FROM point p JOIN box USING (flight_id))"""
_DSM = f"{_GRID}, dsm AS (SELECT flight_id, row, col, max(z) AS z, count(*) AS n FROM grid GROUP BY ALL)"
_DTM = """dtm AS (SELECT flight_id, row, col, min(z) AS z FROM grid JOIN (SELECT flight_id, avg(CASE WHEN label = 2 THEN 1.0 ELSE 0.0 END) >= 0.02 AS classed FROM grid GROUP BY ALL) USING (flight_id) WHERE NOT classed OR label = 2 GROUP BY ALL)"""
_RANK = "{name} AS (SELECT {by}, n, {places} FROM (SELECT {by}, mm, row_number() OVER (PARTITION BY {by} ORDER BY mm) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {table}) WHERE n >= {least} GROUP BY {by}, n)"
_OVERLAP = f"""{_GRID}, v AS (SELECT flight_id, row, col, view, quantile_cont(mm, 0.5) AS m FROM grid GROUP BY ALL HAVING count(*) >= 3), c AS (SELECT flight_id, row, col, round(max(m) - min(m)) AS range FROM v GROUP BY ALL HAVING count(*) >= 2),
overlap AS (SELECT flight_id, count(*) AS cells, round(quantile_cont(range, 0.5), 3) AS median_mm, round(quantile_cont(range, 0.9), 3) AS p90_mm FROM c GROUP BY ALL)"""
_GROUND = "ground AS (SELECT flight_id, round(quantile_cont(round((z - alt_rel) * 1000), 0.5), 1) AS ground_mm FROM point WHERE alt_rel IS NOT NULL GROUP BY ALL)"


def _place(name: str, p: int) -> str:
    return f"max(CASE WHEN i = round_even((n - 1) * {p} / 100, 0) THEN mm END) AS {name}"


def _mean(name: str) -> str:
    return f"{steady_sql(f'avg({name})', 4)} AS {name}"


SQL = {
    "grid_dsm": f"WITH {_DSM} SELECT * FROM dsm",
    "grid_confidence_min": f"WITH {_GRID} SELECT flight_id, row, col, min(tier) AS tier FROM grid GROUP BY ALL",
    "grid_ortho_argmax": f"WITH {_GRID} SELECT flight_id, row, col, sample_id, yaw FROM grid QUALIFY row_number() OVER (PARTITION BY flight_id, row, col ORDER BY z DESC, sample_id) = 1",
    "voxel_downsample": f"WITH {POINTS} SELECT flight_id, {', '.join(f'CAST(floor({a} / 2.0) AS BIGINT) AS i{a}' for a in 'xyz')}, {', '.join(map(_mean, 'xyz'))}, count(*) AS n, min(tier) AS tier FROM point GROUP BY flight_id, floor(x / 2.0), floor(y / 2.0), floor(z / 2.0)",
    "point_dedup_eps": f"WITH {POINTS} SELECT flight_id, {', '.join(f'CAST(round_even({a} / 0.05::DOUBLE, 0) AS BIGINT) AS q{a}' for a in 'xyz')}, {', '.join(map(_mean, 'xyz'))}, count(*) AS n, min(tier) AS tier, min(label) AS label FROM point GROUP BY flight_id, {', '.join(f'round_even({a} / 0.05::DOUBLE, 0)' for a in 'xyz')}",
    "view_bitmask_count": f"""WITH {POINTS}, v AS (SELECT flight_id, {', '.join(f'CAST(floor({a} / 10.0) AS BIGINT) AS i{a}' for a in 'xyz')}, CAST(bit_count(bit_or(1::UBIGINT << ((view % 64 + 64) % 64)::UBIGINT)) AS INTEGER) AS views FROM point GROUP BY flight_id, floor(x / 10.0), floor(y / 10.0), floor(z / 10.0))
SELECT *, CASE WHEN views >= 3 THEN 2 WHEN views = 2 THEN 1 ELSE 0 END AS tier FROM v""",
    "consensus_height": f"""WITH {_GRID}, w AS (SELECT *, 1 / (1 + coalesce(acc, 2.0) * coalesce(acc, 2.0)) AS w FROM grid), v AS (SELECT flight_id, row, col, CAST({steady_sql('sum(z * w) / sum(w) * 1000', 0)} AS BIGINT) AS z FROM w WHERE w > 0 GROUP BY flight_id, row, col, view),
n AS (SELECT *, count(*) OVER w AS n_agree, avg(z) OVER w AS m FROM v WINDOW w AS (PARTITION BY flight_id, row, col ORDER BY z RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING)),
b AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY flight_id, row, col ORDER BY n_agree DESC, z) = 1)
SELECT flight_id, row, col, {steady_sql('m / 1000', 4)} AS z, n_agree, CASE WHEN n_agree >= 3 THEN 2 WHEN n_agree = 2 THEN 1 ELSE 0 END AS tier FROM b""",
    "heightmap_mesh_blocks": f"""WITH {_DSM}, b AS (SELECT a.flight_id, a.row, a.col, round(greatest(a.z, b.z, c.z, e.z) - least(a.z, b.z, c.z, e.z), 3) AS span FROM dsm a JOIN dsm b ON b.flight_id = a.flight_id AND b.row = a.row AND b.col = a.col + 1 JOIN dsm c ON c.flight_id = a.flight_id AND c.row = a.row + 1 AND c.col = a.col JOIN dsm e ON e.flight_id = a.flight_id AND e.row = a.row + 1 AND e.col = a.col + 1)
SELECT * FROM b WHERE span <= 3""",
    "cell_percentile_nearest_rank": f"WITH {_GRID}, {_RANK.format(name='r', by='flight_id, row, col', table='grid', least=3, places=_place('p5', 5) + ', ' + _place('p95', 95))} SELECT *, p95 - p5 AS span FROM r",
    "flat_cells": f"""WITH {_GRID}, c AS (SELECT flight_id, row, col, CAST(round((max(z) - min(z)) * 1000) AS BIGINT) AS span FROM grid GROUP BY ALL HAVING count(*) >= 5) SELECT flight_id, row, col, span FROM c JOIN (SELECT flight_id, quantile_cont(span, 0.25) AS m FROM c GROUP BY ALL) USING (flight_id) WHERE span <= greatest(1500.0, m)""",
    "overlap_disagreement": f"WITH {_OVERLAP} SELECT * FROM overlap",
    "reference_ground_error": f"""WITH {_GRID}, part AS (SELECT *, CAST(floor(view / 15) AS BIGINT) AS part FROM grid), {_RANK.format(name='o', by='flight_id, row, col, part', table='part', least=5, places=_place('own', 10))}, {_RANK.format(name='g', by='flight_id, row, col', table='grid', least=10, places=_place('ground', 10))}
SELECT flight_id, part, round(quantile_cont(own - ground, 0.5), 2) AS error_mm FROM o JOIN g USING (flight_id, row, col) GROUP BY flight_id, part""",
    "placement_verdict": f"""WITH {_OVERLAP} SELECT flight_id, coalesce(cells, 0) AS cells, CASE WHEN coalesce(cells, 0) < 3 THEN 'UNMEASURED' WHEN median_mm > 1000 OR p90_mm > 5000 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM (SELECT DISTINCT flight_id FROM point) LEFT JOIN overlap USING (flight_id)""",
    "dtm_min_ground": f"WITH {_GRID}, {_DTM} SELECT * FROM dtm",
    "height_above_ground": f"WITH {_DSM}, {_DTM} SELECT flight_id, row, col, greatest(0.0, round(dsm.z - dtm.z, 3)) AS h FROM dsm JOIN dtm USING (flight_id, row, col)",
    "ground_z": f"WITH {POINTS}, {_GROUND} SELECT * FROM ground",
    "ground_band_filter": f"""WITH {POINTS}, {_GROUND}, b AS (SELECT p.*, z BETWEEN ground_mm / 1000 - 60 AND ground_mm / 1000 + 80 AS inside FROM point p JOIN ground USING (flight_id)), s AS (SELECT flight_id, avg(CASE WHEN inside THEN 0.0 ELSE 1.0 END) > 0.25 AS declined FROM b GROUP BY ALL)
SELECT flight_id, sample_id FROM b JOIN s USING (flight_id) WHERE declined OR inside""",
    "crop_bounds": f"WITH {POINTS} SELECT flight_id, sample_id FROM point WHERE x BETWEEN -150 AND 150 AND y BETWEEN -150 AND 150 AND z >= -20",
    "confidence_filter": f"WITH {POINTS} SELECT flight_id, sample_id, tier FROM point WHERE tier >= 1",
    "hole_fill_nearest": f"""WITH {_DSM}, b AS (SELECT flight_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM dsm GROUP BY ALL), s AS (SELECT i, j FROM range(-6, 7) a(i), range(-6, 7) b(j) WHERE i * i + j * j <= 36),
o AS (SELECT flight_id, row + i AS row, col + j AS col, i * i + j * j AS d2, row AS r, col AS c, z FROM dsm, s) SELECT flight_id, row, col, z, d2 > 0 AS filled FROM o JOIN b USING (flight_id) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1
QUALIFY row_number() OVER (PARTITION BY flight_id, row, col ORDER BY d2, r, c) = 1""",
    "occupied_area": f"""WITH {_GRID}, c AS (SELECT flight_id, row, col, count(*) AS n, round((max(z) - min(z)) * 1000) AS span FROM grid GROUP BY ALL) SELECT flight_id, count(*) * {RES * RES}::DOUBLE AS area_m2, quantile_cont(span, 0.5) FILTER (n >= 5) AS relief_mm FROM c GROUP BY flight_id""",
    "uncertainty_summary": f"""WITH {POINTS}, m AS (SELECT flight_id, round(acc * 1000) AS mm FROM point WHERE acc > 0) SELECT flight_id, round(quantile_cont(mm, 0.5), 3) AS median_mm, round(quantile_cont(mm, 0.9), 3) AS p90_mm, round(avg(CASE WHEN mm <= 500 THEN 1.0 ELSE 0.0 END), 6) AS within_05, round(avg(CASE WHEN mm <= 1000 THEN 1.0 ELSE 0.0 END), 6) AS within_1 FROM m GROUP BY flight_id""",
    "auto_voxel_size": f"""WITH {POINTS}, e AS (SELECT flight_id, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS e FROM point GROUP BY ALL) SELECT flight_id, round(least(5.0, greatest(0.05, e / 200)), 6) AS voxel_m, round(greatest(0.01, e / 512), 6) AS res_m FROM e""",
    "radius_outlier_removal": f"""WITH {POINTS} SELECT a.flight_id, a.sample_id FROM point a JOIN point b ON b.flight_id = a.flight_id AND b.x BETWEEN a.x - 6 AND a.x + 6 AND (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) <= 36 GROUP BY ALL HAVING count(*) >= 5""",
    "zbuffer_visible": f"WITH {POINTS}, t AS (SELECT *, max(z) OVER (PARTITION BY flight_id, view, floor(x / 4.0), floor(y / 4.0)) AS top FROM point) SELECT flight_id, view, sample_id FROM t WHERE z >= round(top - 0.5, 3)",
    "weighted_label_vote": f"""WITH {_GRID}, p AS (SELECT *, 1 / (1 + coalesce(acc, 2.0)) * least((40 / greatest(1.0, abs(coalesce(alt_rel, z)))) ** 2, 4.0) * least(1.0, greatest(0.05, abs(sin(radians(coalesce(pitch, -90.0)))))) AS w FROM grid WHERE label > 0),
v AS (SELECT flight_id, row, col, label, sum(w) AS w FROM p GROUP BY ALL), t AS (SELECT *, sum(w) OVER (PARTITION BY flight_id, row, col) AS total FROM v), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY flight_id, row, col ORDER BY round(w, 9) DESC, label) = 1),
n AS (SELECT flight_id, row, col, count(DISTINCT view) AS views FROM p GROUP BY ALL), r AS (SELECT *, CASE WHEN views < 2 THEN 'few_views' WHEN total <= 0 THEN 'no_weight' WHEN {steady_sql('round(w, 9) / total', 6)} < 0.6 THEN 'split_vote' ELSE 'ok' END AS reason FROM b JOIN n USING (flight_id, row, col))
SELECT flight_id, row, col, CASE WHEN reason = 'ok' THEN label ELSE 0 END AS label, {steady_sql('round(w, 9) / total', 5)} AS ratio, views, reason FROM r""",
    "class_histogram": f"WITH {POINTS} SELECT flight_id, label, round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY flight_id), 2) AS pct FROM point GROUP BY flight_id, label",
    "vertical_profile": f"""WITH {_DSM}, t AS (SELECT flight_id, row, col, min(tier) AS tier FROM grid GROUP BY ALL), c AS (SELECT * FROM dsm JOIN t USING (flight_id, row, col)),
b AS (SELECT a.flight_id, a.z AS z0, b.z AS z1, c.z AS z2, e.z AS z3, least(a.tier, b.tier, c.tier, e.tier) AS tier FROM c a JOIN c b ON b.flight_id = a.flight_id AND b.row = a.row AND b.col = a.col + 1 JOIN c ON c.flight_id = a.flight_id AND c.row = a.row + 1 AND c.col = a.col JOIN c e ON e.flight_id = a.flight_id AND e.row = a.row + 1 AND e.col = a.col + 1)
SELECT flight_id, count(*) * 2 AS triangles, round(count(*) * {RES * RES}::DOUBLE, 3) AS plan_m2, round(sum(sqrt(((z1 - z0) * {RES}) ** 2 + ((z2 - z0) * {RES}) ** 2 + {RES**4}) / 2 + sqrt(((z1 - z3) * {RES}) ** 2 + ((z2 - z3) * {RES}) ** 2 + {RES**4}) / 2), 3) AS area_m2,
  {', '.join(f'round(avg(CASE WHEN tier = {k} THEN 1.0 ELSE 0.0 END) * 100, 2) AS pct{k}' for k in (0, 1, 2))} FROM b GROUP BY flight_id""",
    "cut_fill_volume": f"""WITH {_DSM}, c AS (SELECT flight_id, col * {RES} AS u, -row * {RES} AS v, z FROM dsm), m AS (SELECT flight_id, avg(u) AS mu, avg(v) AS mv, avg(z) AS mz, var_pop(u) AS suu, var_pop(v) AS svv, covar_pop(u, v) AS suv, covar_pop(u, z) AS suz, covar_pop(v, z) AS svz FROM c GROUP BY ALL),
s AS (SELECT *, (suz * svv - svz * suv) / (suu * svv - suv * suv) AS a, (svz * suu - suz * suv) / (suu * svv - suv * suv) AS b FROM m WHERE suu * svv - suv * suv > 1e-6), r AS (SELECT c.flight_id, z - (mz + a * (u - mu) + b * (v - mv)) AS dz FROM c JOIN s USING (flight_id))
SELECT flight_id, round(sum(greatest(dz, 0.0)) * {RES * RES}, 2) AS above_m3, round(-sum(least(dz, 0.0)) * {RES * RES}, 2) AS below_m3, count(*) AS cells FROM r GROUP BY flight_id""",
    "elevation_profile": f"""WITH {_DSM}, r AS (SELECT d.* FROM dsm d JOIN (SELECT flight_id, CAST(floor(max(row) / 2) AS BIGINT) AS mid FROM dsm GROUP BY ALL) USING (flight_id) WHERE row IN (mid, mid + 1)), n AS (SELECT flight_id, col, avg(z) AS z FROM r GROUP BY ALL HAVING count(*) = 2)
SELECT a.flight_id, (a.col + k) * {RES} AS d_m, {steady_sql('a.z + (b.z - a.z) * k', 4)} AS z FROM n a JOIN n b ON b.flight_id = a.flight_id AND b.col = a.col + 1, (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) t(k)""",
    "coverage_counts": f"""WITH {POINTS}, v AS (SELECT flight_id, view, {', '.join(f'CAST(floor({f}({a}) / 10) AS BIGINT) AS {n}{a}' for a in 'xy' for n, f in (('lo', 'min'), ('hi', 'max')))} FROM point GROUP BY ALL), r AS (SELECT flight_id, unnest(range(lox, hix + 1)) AS i, loy, hiy FROM v), q AS (SELECT flight_id, i, unnest(range(loy, hiy + 1)) AS j FROM r),
c AS (SELECT flight_id, i, j, count(*) AS seen FROM q GROUP BY ALL) SELECT flight_id, count(*) AS cells, quantile_cont(seen, 0.5) AS median_seen, min(seen) AS least_seen, round(avg(CASE WHEN seen = 1 THEN 1.0 ELSE 0.0 END), 6) AS seen_once FROM c GROUP BY flight_id""",
}
QUERIES = {name: globals()[name] for name in SQL}
