"""Similarities (scale, rotation, shift) between paired points of each group, by least squares and by consensus.

Points are summed into moments before they meet: means, covariances and counts are all a fit needs, so a group of any size is
one row when it is solved. A consensus fit takes its hypotheses from triples of points chosen by hash, a fixed number for each
group, counts for every hypothesis the points it explains, and fits again to those of the best.

Defined results
---------------
* Points with NULL or NaN coordinates: not used. Groups of fewer than three points: no row. Empty tables: no rows.
* Points on a line (``condition`` over 1e6): ``degenerate``; scale and shift hold, the turn about the line is arbitrary.
* Equal counts of two hypotheses: the lower number. Repeated points weigh as often as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrelgrid.functions.camera import rotated

FROM, TO = ("x", "y", "z"), ("u", "v", "w")
R = [f"r{i}{j}" for i in range(3) for j in range(3)]
SHIFT = ["tx", "ty", "tz"]
MOST_CONDITION = 1e6


def _sound(pairs: DataFrame) -> DataFrame:
    for c in (*FROM, *TO):
        pairs = pairs.where(F.col(c).isNotNull() & ~F.isnan(c))
    return pairs


def moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: (by, x, y, z, u, v, w). Result: one row a group: n, means m<c>, covariances c<to><from> and s<from><from>, and the variances d<to> of the targets."""
    across = [F.covar_pop(a, b).alias(f"c{a}{b}") for a in TO for b in FROM]
    own = [F.covar_pop(a, b).alias(f"s{a}{b}") for i, a in enumerate(FROM) for b in FROM[i:]]
    return _sound(pairs).groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in (*FROM, *TO)], *across, *own, *[F.var_pop(c).alias(f"d{c}") for c in TO])


def solve(m: np.ndarray, mean_from: np.ndarray, mean_to: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scale, rotation, shift, condition) of stacks of covariances ``m`` (to by from) and ``spread`` (from by from)."""
    u, d, vt = np.linalg.svd(m)
    flip = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
    d[:, 2] *= flip
    u[:, :, 2] *= flip[:, None]
    turn = u @ vt
    total = np.trace(spread, axis1=1, axis2=2)
    scale = np.where(total > 1e-12, d.sum(axis=1) / np.where(total > 1e-12, total, 1), 1.0)
    shift = mean_to - scale[:, None] * np.einsum("nij,nj->ni", turn, mean_from)
    sizes = np.linalg.svd(spread, compute_uv=False)
    return scale, turn, shift, np.where(sizes[:, 1] > 1e-12, sizes[:, 0] / np.where(sizes[:, 1] > 1e-12, sizes[:, 1], 1), np.inf)


def similarity_fits(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Result: (by, n, scale, r00 .. r22, tx, ty, tz, rmse, condition, degenerate), of groups of three points or more."""
    held = moments(pairs, by).where("n >= 3")
    kinds = dict(held.dtypes)
    names = [*by, "n", "scale", *R, *SHIFT, "rmse", "condition"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            m = np.stack([np.stack([col(f"c{a}{b}") for b in FROM], 1) for a in TO], 1)
            s = np.stack([np.stack([col(f"s{min(a, b)}{max(a, b)}") for b in FROM], 1) for a in FROM], 1)
            to = np.stack([col(f"m{c}") for c in TO], 1)
            scale, turn, shift, condition = solve(m, np.stack([col(f"m{c}") for c in FROM], 1), to, s)
            left = sum(col(f"d{c}") for c in TO) - 2 * scale * np.einsum("nij,nij->n", turn, m) + scale**2 * np.trace(s, axis1=1, axis2=2)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*by, "n")), pa.array(scale), *(pa.array(turn[:, k // 3, k % 3]) for k in range(9)), *(pa.array(shift[:, k]) for k in range(3)), pa.array(np.sqrt(np.maximum(left, 0))), pa.array(condition)], names
            )

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "n bigint", *(f"{c} double" for c in names[len(by) + 1 :])])
    return held.mapInArrow(fit, schema).withColumn("degenerate", F.col("condition") > MOST_CONDITION)


def residual() -> Column:
    """Distance of a pair's target from where a fit in the same row puts it."""
    placed = [F.col("scale") * p + F.col(t) for p, t in zip(rotated([F.col(r) for r in R], [F.col(c) for c in FROM]), SHIFT)]
    return F.sqrt(sum((F.pow(F.col(c) - p, 2) for c, p in zip(TO, placed)), F.lit(0.0)))


def known_rotation_fits(pairs: DataFrame, by: list[str], scale: float | None = None) -> DataFrame:
    """pairs: (by, x .. w, r00 .. r22), the rotation alike in a group. Result: (by, n, scale, tx, ty, tz): scale (unless given) and shift by least squares, NULL for points in one place."""
    turned = rotated([F.col(r) for r in R], [F.col(c) for c in FROM])
    p = _sound(pairs).withColumns({f"q{c}": t for c, t in zip(FROM, turned)})
    both, own = (sum((F.covar_pop(f"q{c}", k) for c, k in zip(FROM, pair)), F.lit(0.0)) for pair in (TO, [f"q{c}" for c in FROM]))
    g = p.groupBy(*by).agg(F.count("*").alias("n"), both.alias("both"), own.alias("own"), *[F.avg(f"q{c}").alias(f"m{c}") for c in FROM], *[F.avg(c).alias(f"m{c}") for c in TO])
    s = F.lit(float(scale)) if scale is not None else F.when(F.col("own") > 1e-12, F.col("both") / F.col("own"))
    return g.withColumn("scale", s).select(*by, "n", "scale", *[(F.col(f"m{k}") - F.col("scale") * F.col(f"m{c}")).alias(t) for k, c, t in zip(TO, FROM, SHIFT)])


def robust_similarity(pairs: DataFrame, by: list[str], key: str, *, within: float, hypotheses: int = 64) -> DataFrame:
    """similarity_fits() of the points that the best of ``hypotheses`` explains to ``within``; adds inliers and total. ``key`` names a point.

    A group is as many rows as hypotheses only where it is counted, in partial sums.
    """
    p = _sound(pairs).select(*by, key, *FROM, *TO)
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(3 * hypotheses)).cast("int")
    chosen = p.withColumn("slot", slot).groupBy(*by, "slot").agg(F.min_by(F.struct(*FROM, *TO), F.struct(F.xxhash64(F.col(key), F.lit("order")), F.col(key))).alias("p"))
    triples = chosen.select(*by, (F.col("slot") / 3).cast("int").alias("h"), "p.*")
    fits = similarity_fits(triples, [*by, "h"]).where((F.col("n") == 3) & ~F.col("degenerate"))
    asked = p.join(fits.drop("n", "rmse", "condition", "degenerate"), by).where(residual() <= within)
    best = asked.groupBy(*by, "h").agg(F.count("*").alias("agree")).groupBy(*by).agg(F.max(F.struct("agree", (-F.col("h")).alias("low"))).alias("b"))
    winner = best.select(*by, (-F.col("b.low")).alias("h")).join(fits, [*by, "h"]).drop("h", "n", "rmse", "condition", "degenerate")
    # without a hypothesis, all points count
    kept = p.join(winner, by, "left").where(F.coalesce(residual() <= within, F.lit(True))).select(*by, *FROM, *TO)
    total = p.groupBy(*by).agg(F.count("*").alias("total"))
    return similarity_fits(kept, by).join(total, by).withColumnRenamed("n", "inliers")
