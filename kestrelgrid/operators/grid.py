"""Points onto cells and voxels, and reducers over them.

Every reducer aggregates partially before its shuffle, so a cell that holds a third of all points costs no task more than
a few rows. Where a reducer needs an order (percentiles), values are counted on a stated resolution first: what meets in
a task is bounded by the values that differ, not by the points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def raster_cells(points: DataFrame, by: list[str], res: float) -> DataFrame:
    """Adds row and col on a grid from the points' own bounds, row 0 in the north.

    Columns and rows are cut off towards 0 and clipped into the grid, so that points on the far edges stay in it.
    """
    box = points.groupBy(*by).agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    size = lambda a, b: F.greatest(F.lit(1), F.ceil((F.col(b) - F.col(a)) / res)).cast("bigint")
    box = box.select(*by, "x_min", "y_max", size("x_min", "x_max").alias("n_cols"), size("y_min", "y_max").alias("n_rows"))
    at = lambda d, n: F.least(F.floor(d / res).cast("bigint"), F.col(n) - 1)
    return points.join(box, by).withColumns({"row": at(F.col("y_max") - F.col("y"), "n_rows"), "col": at(F.col("x") - F.col("x_min"), "n_cols")}).drop("x_min", "y_max", "n_cols", "n_rows")


def voxel(name: str, size: float) -> Column:
    return F.floor(F.col(name) / size).cast("bigint")


def nearest_rank(df: DataFrame, by: list[str], value: str, percents: dict[str, float], least: int = 1) -> DataFrame:
    """Nearest-rank percentiles, the place being (n - 1) p / 100 rounded half to even, of whole-number values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    c = counts.withColumns({"upto": F.sum("n").over(w.orderBy(value)), "total": F.sum("n").over(w)}).where(F.col("total") >= least)
    place = lambda p: F.rint((F.col("total") - 1) * p / 100)
    return c.groupBy(*by).agg(F.first("total").alias("n"), *[F.min(F.when(F.col("upto") > place(p), F.col(value))).alias(name) for name, p in percents.items()])


def counted_median(df: DataFrame, by: list[str], value: str, share: float = 0.5) -> DataFrame:
    """(by, m): the interpolated percentile of whole-number values, counted before they meet."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.percentile(value, F.lit(share), F.col("n")).alias("m"))


def consensus(votes: DataFrame, by: list[str], agree: int) -> DataFrame:
    """votes: one row (by, z bigint) for each voter. The vote with most votes within +-agree wins, the lowest of equals.

    Result: (by, z_mean, n_agree): the plain mean of the votes that agree with the winner.
    """
    w = Window.partitionBy(*by).orderBy("z").rangeBetween(-agree, agree)
    near = votes.withColumns({"n_agree": F.count("*").over(w), "mean": F.avg("z").over(w)})
    return near.groupBy(*by).agg(F.max(F.struct("n_agree", (-F.col("z")).alias("low"), "mean")).alias("b")).select(*by, F.col("b.mean").alias("z_mean"), F.col("b.n_agree").alias("n_agree"))


def fill_nearest(cells: DataFrame, by: list[str], value: str, reach: int) -> DataFrame:
    """cells: (by, row, col, value). Adds the holes within ``reach`` cells of a known cell, inside the known bounds.

    A hole takes the value of the nearest known cell, of equals the one first by row and column. Each known cell is
    offered to the cells around it, a fixed number, and each hole keeps its best offer.
    """
    box = cells.groupBy(*by).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    offers = F.array(*[F.struct(F.lit(i * i + j * j).alias("d2"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])
    o = cells.select(*by, "row", "col", value, F.explode(offers).alias("o"))
    o = o.select(*by, (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), F.struct("o.d2", F.col("row").alias("r"), F.col("col").alias("c"), value).alias("b"))
    best = o.groupBy(*by, "row", "col").agg(F.min("b").alias("b")).join(box, by).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return best.select(*by, "row", "col", F.col(f"b.{value}").alias(value), (F.col("b.d2") > 0).alias("filled"))


def radius_outliers(points: DataFrame, by: list[str], key: str, radius: float, least: int) -> DataFrame:
    """(by, key) of the points with at least ``least`` others within ``radius``.

    Cells have the side radius / sqrt(3), so all points of one cell lie within the radius of each other and a cell of more
    than ``least`` points keeps all its points without a distance. Only points of thinner cells, at most ``least`` each,
    are compared, with the places of the cells around: points at one place, to the millimetre the points come in, are
    counted first and compared once.
    """
    side = radius / 3**0.5
    cell = {f"c{a}": voxel(a, side) for a in "xyz"}
    p = points.select(*by, key, "x", "y", "z").withColumns(cell)
    crowd = p.groupBy(*by, *cell).agg(F.count("*").alias("n"))
    dense = crowd.where(F.col("n") > least)
    kept = p.join(dense.drop("n"), [*by, *cell], "left_semi").select(*by, key)
    thin = p.join(dense.drop("n"), [*by, *cell], "left_anti")
    places = p.groupBy(*by, *cell, "x", "y", "z").agg(F.count("*").alias("n"))
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)]
    asked = thin.withColumn("o", F.explode(F.array(*around))).select(*by, key, F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), *[(F.col(f"c{a}") + F.col(f"o.{b}")).alias(f"c{a}") for a, b in zip("xyz", "ijk")])
    d2 = sum((F.pow(F.col(a) - F.col(f"p{a}"), 2) for a in "xyz"), F.lit(0.0))
    near = asked.join(places, [*by, *cell]).where(d2 <= radius * radius).groupBy(*by, key).agg((F.sum("n") - 1).alias("others"))
    return kept.unionByName(near.where(F.col("others") >= least).select(*by, key))
