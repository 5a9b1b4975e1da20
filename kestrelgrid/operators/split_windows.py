"""Ordered operators over long sequences, without putting a sequence into one task.

A window partitioned by a key alone gathers all rows of that key in one task. Here a sequence is cut by a ``bucket``
column that grows with the order (a span of time, say); windows run inside (key, bucket), and only one row of each bucket
is carried over the buckets of a key. Results are those of the plain windows.

Rows whose key or bucket is NULL are left out. Names starting with two underscores are used inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _known(df: DataFrame, by: list[str], bucket: str) -> DataFrame:
    for name in (*by, bucket):
        df = df.where(F.col(name).isNotNull())
    return df


def neighbours(df: DataFrame, by: list[str], order: list[str], bucket: str, fields: list[str]) -> DataFrame:
    """Adds ``prev`` and ``next``: structs of ``order`` and ``fields`` of the rows before and after."""
    row = F.struct(*order, *[f for f in fields if f not in order])
    inside, over = Window.partitionBy(*by, bucket).orderBy(*order), Window.partitionBy(*by).orderBy(bucket)
    df = _known(df, by, bucket)
    edges = df.groupBy(*by, bucket).agg(F.min(row).alias("__first"), F.max(row).alias("__last"))
    edges = edges.select(*by, bucket, F.lag("__last").over(over).alias("__before"), F.lead("__first").over(over).alias("__after"))
    rows = df.withColumns({"prev": F.lag(row).over(inside), "next": F.lead(row).over(inside)})
    return rows.join(edges, [*by, bucket]).withColumns({"prev": F.coalesce("prev", "__before"), "next": F.coalesce("next", "__after")}).drop("__before", "__after")


def carried(df: DataFrame, by: list[str], order: list[Column], bucket: str, columns: dict[str, Column], *, forward: bool = True) -> DataFrame:
    """Adds, for each name, the last value that isn't NULL of its expression up to and with the row.

    ``order`` must put rows in the wanted direction; forward=False means that buckets run downwards.
    """
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = Window.partitionBy(*by).orderBy(F.col(bucket) if forward else F.desc(bucket)).rowsBetween(Window.unboundedPreceding, -1)
    df = _known(df, by, bucket)
    rows = df.withColumns({n: F.last(c, ignorenulls=True).over(inside) for n, c in columns.items()} | {f"__{n}": F.last(c, ignorenulls=True).over(whole) for n, c in columns.items()})
    kept = rows.groupBy(*by, bucket).agg(*[F.first(f"__{n}").alias(f"__{n}") for n in columns])
    kept = kept.select(*by, bucket, *[F.last(f"__{n}", ignorenulls=True).over(over).alias(f"__e_{n}") for n in columns])
    joined = rows.drop(*[f"__{n}" for n in columns]).join(kept, [*by, bucket])
    return joined.withColumns({n: F.coalesce(n, f"__e_{n}") for n in columns}).drop(*[f"__e_{n}" for n in columns])


def running(df: DataFrame, by: list[str], order: list[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Adds running sums up to and with the row; NULLs count as nothing, an empty sum is 0."""
    inside, over = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by).orderBy(bucket)
    df = _known(df, by, bucket)
    rows = df.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    totals = df.groupBy(*by, bucket).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{n}") for n, c in sums.items()])
    totals = totals.select(*by, bucket, *[(F.sum(f"__{n}").over(over) - F.col(f"__{n}")).alias(f"__{n}") for n in sums])
    return rows.join(totals, [*by, bucket]).withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop(*[f"__{n}" for n in sums])


def numbered(df: DataFrame, by: list[str], order: list[str], bucket: str, name: str = "i") -> DataFrame:
    """Adds the row's place in its sequence, from 0."""
    return running(df, by, order, bucket, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) - 1)


def haloed(df: DataFrame, by: list[str], index: str, halo: int, chunk: int = 4096) -> DataFrame:
    """Copies rows near a border of a run of ``chunk`` rows into the neighbouring run too: (.., run, own).

    Frames of at most ``halo`` rows to either side, over windows by (key, run), are then those of the whole sequence for
    the rows that are ``own``.
    """
    i = F.col(index)
    runs = F.array_distinct(F.array(*[F.floor((i + k) / chunk).cast("bigint") for k in (0, -halo, halo)]))
    return _known(df, by, index).withColumn("run", F.explode(runs)).withColumn("own", F.floor(i / chunk) == F.col("run"))
