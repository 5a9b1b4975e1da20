"""The lag between two clocks, by how well turns seen on one follow the heading logged on the other.

For each lag of the range, by a tenth of a second, and either sense of rotation, the turn of every pair is held against the
change of the heading; differences are wrapped, cut off at ``CLIP`` degrees, squared and averaged. The best is refined by a
hundredth and a parabola, and judged: enough turning pairs, a small median residual of these, a sharp minimum, no other lag as
good.

Pairs and headings meet by (key, span of ten minutes), with the headings that any lag of the range can reach copied to both
spans; only sums for each lag leave a span. Headings are not interpolated over gaps of more than ``GAP_S``; pairs that fall
into one don't count at that lag.

Defined results
---------------
* NULL or NaN turns, times, headings: not used. Repeated rows count as often as they come. Empty tables: no rows.
* Fewer than three pairs, or no lag that keeps half of them: no row. Costs that are equal: the smaller lag, then the sign 1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.operators.components import checkpointed
from kestrelgrid.operators.grid import counted_median

SPAN_MS, GAP_S, PAIR_S = 600_000, 30.0, 60.0
CLIP, TURN_DEG, LEAST_TURNING, MOST_RESIDUAL, LEAST_SHARP, LEAST_UNIQUE = 20.0, 5.0, 3, 3.0, 2.0, 1.5


def _wrap(x: np.ndarray) -> np.ndarray:
    return (x + 180.0) % 360.0 - 180.0


def _change(pairs: pd.DataFrame, heading: pd.DataFrame, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Change of the heading over each pair at each lag, and whether both ends lie between headings that are near enough."""
    heading = heading.groupby("t_ms", as_index=False)["deg"].first()
    t, h = heading["t_ms"].to_numpy() / 1000.0, np.degrees(np.unwrap(np.radians(heading["deg"].to_numpy())))
    ends, ok = [], np.ones((len(pairs), len(lags)), bool)
    for name in ("a_ms", "b_ms"):
        at = pairs[name].to_numpy()[:, None] / 1000.0 + lags[None, :]
        after = np.clip(np.searchsorted(t, at, side="left"), 0, len(t) - 1)
        before = np.where(t[after] == at, after, np.maximum(after - 1, 0))
        ok &= (t[before] <= at) & (at <= t[after]) & (t[after] - t[before] <= GAP_S)
        ends.append(np.interp(at, t, h))
    return ends[1] - ends[0], ok


def _met(pairs: DataFrame, heading: DataFrame, reach_s: float, judge, schema: str) -> DataFrame:
    """``judge(pairs, heading)`` of each key and span; pairs carry the lags asked of their key."""
    reach = int((reach_s + GAP_S + PAIR_S) * 1000)
    spans = F.sequence(F.floor((F.col("t_ms") - reach) / SPAN_MS).cast("bigint"), F.floor((F.col("t_ms") + reach) / SPAN_MS).cast("bigint"))
    left = pairs.withColumn("span", F.floor(F.col("a_ms") / SPAN_MS).cast("bigint")).groupBy("key", "span")
    right = heading.withColumn("span", F.explode(spans)).groupBy("key", "span")
    return left.cogroup(right).applyInPandas(judge, schema)


def _costs(pairs: DataFrame, heading: DataFrame, lags: DataFrame, reach_s: float) -> DataFrame:
    """lags: (key, lags array). Result: (key, k, lag, n, cost_1, cost_2): mean squared residual at the k-th lag under sign 1 and -1."""

    def judge(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"key": [], "k": [], "lag": [], "n": [], "s1": [], "s2": []}).astype({"key": object, "k": "int32", "n": "int64"})
        asked = np.asarray(mine["lags"].iloc[0], float)
        change, ok = _change(mine, theirs, asked)
        turn = mine["turn"].to_numpy()[:, None]
        sums = [np.where(ok, np.minimum(np.abs(_wrap(turn - sign * change)), CLIP) ** 2, 0.0).sum(axis=0) for sign in (1.0, -1.0)]
        return pd.DataFrame({"key": mine["key"].iloc[0], "k": np.arange(len(asked), dtype="int32"), "lag": asked, "n": ok.sum(axis=0), "s1": sums[0], "s2": sums[1]})

    kind = dict(pairs.dtypes)["key"]
    found = _met(pairs.join(lags, "key"), heading, reach_s, judge, f"key {kind}, k int, lag double, n bigint, s1 double, s2 double")
    total = found.groupBy("key", "k").agg(F.first("lag").alias("lag"), F.sum("n").alias("n"), F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).where("n > 0")
    return total.select("key", "k", "lag", "n", (F.col("s1") / F.col("n")).alias("cost_1"), (F.col("s2") / F.col("n")).alias("cost_2"))


def estimate_lags(pairs: DataFrame, heading: DataFrame, ranges: DataFrame, *, widest_s: float = 15.0) -> DataFrame:
    """pairs: (key, a_ms, b_ms, turn), at most a minute long; heading: (key, t_ms, deg); ranges: (key, lo_s, hi_s), one row a key, inside +-widest_s.

    Result: (key, lag_s, sign, confident, reason, pairs, turning_pairs, median_residual, sharpness, uniqueness).
    """
    pairs = checkpointed(pairs.where("a_ms IS NOT NULL AND b_ms > a_ms AND turn IS NOT NULL AND NOT isnan(turn)").where(F.col("b_ms") - F.col("a_ms") <= PAIR_S * 1000).select("key", "a_ms", "b_ms", F.col("turn").cast("double").alias("turn")))
    heading = checkpointed(heading.where("t_ms IS NOT NULL AND deg IS NOT NULL AND NOT isnan(deg)").select("key", "t_ms", F.col("deg").cast("double").alias("deg")))
    enough = pairs.groupBy("key").agg(F.count("*").alias("all")).where("all >= 3").withColumn("least", F.greatest(F.lit(3), F.floor(F.col("all") / 2)))
    lo, hi = F.greatest(F.col("lo_s"), F.lit(-widest_s)), F.least(F.col("hi_s"), F.lit(widest_s))
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((hi - lo) * 10 + 1e-6)).cast("int"))
    coarse = ranges.where("lo_s <= hi_s").join(enough, "key").select("key", F.transform(steps, lambda k: lo + k * 0.1).alias("lags"))
    reach = widest_s + 2
    table = checkpointed(_costs(pairs, heading, coarse, reach).join(enough, "key").where(F.col("n") >= F.col("least")))
    best = table.groupBy("key").agg(F.min(F.struct(F.least("cost_1", "cost_2").alias("cost"), "k", F.when(F.col("cost_1") <= F.col("cost_2"), 1).otherwise(-1).alias("sign"), "lag")).alias("b")).select("key", F.col("b.lag").alias("at"), F.col("b.sign").alias("sign"))
    best = checkpointed(best)
    own = F.when(F.col("sign") == 1, F.col("cost_1")).otherwise(F.col("cost_2")).alias("cost")
    fine = best.select("key", F.transform(F.sequence(F.lit(-15), F.lit(15)), lambda k: F.col("at") + k * 0.01).alias("lags"))
    refined = _costs(pairs, heading, fine, reach).join(enough, "key").where(F.col("n") >= F.col("least")).join(best, "key").select("key", "k", "lag", own)
    by_k = refined.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("k", "cost"))).alias("costs"), F.min(F.struct("cost", "k", "lag")).alias("b"))
    c = {j: F.try_element_at("costs", F.col("b.k") + j) for j in (-1, 0, 1)}
    bend = c[-1] - 2 * c[0] + c[1]
    lag = F.col("b.lag") + F.when(bend > 0, 0.005 * (c[-1] - c[1]) / bend).otherwise(0.0)
    settled = checkpointed(by_k.select("key", F.coalesce(lag, F.col("b.lag")).alias("lag_s")).join(best.select("key", "sign"), "key"))
    around = settled.select("key", F.array(F.col("lag_s"), F.col("lag_s") - 1, F.col("lag_s") + 1).alias("lags"))
    at = _costs(pairs, heading, around, reach).join(enough, "key").where((F.col("k") == 0) | (F.col("n") >= F.col("least"))).join(settled, "key").select("key", "k", "n", own)
    at = at.groupBy("key").agg(F.max(F.when(F.col("k") == 0, F.greatest("cost", F.lit(1e-6)))).alias("cost"), F.max(F.when(F.col("k") == 0, F.col("n"))).alias("pairs"), F.min(F.when(F.col("k") > 0, F.col("cost"))).alias("near"))
    far = table.join(settled, "key").where(F.abs(F.col("lag") - F.col("lag_s")) > 2).select("key", own).groupBy("key").agg(F.min("cost").alias("far"))

    def residuals(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"key": [], "milli": []}).astype({"key": object, "milli": "int64"})
        change, ok = _change(mine, theirs, np.array([float(mine["lag_s"].iloc[0])]))
        turn = mine["turn"].to_numpy()
        left = np.abs(_wrap(turn - mine["sign"].to_numpy() * change[:, 0]))
        kept = ok[:, 0] & (np.abs(turn) >= TURN_DEG)
        return pd.DataFrame({"key": mine["key"].to_numpy()[kept], "milli": np.rint(left[kept] * 1000).astype("int64")})

    turning = checkpointed(_met(pairs.join(settled, "key"), heading, reach, residuals, f"key {dict(pairs.dtypes)['key']}, milli bigint"))
    turned = turning.groupBy("key").agg(F.count("*").alias("turning_pairs")).join(counted_median(turning, ["key"], "milli"), "key")
    j = settled.join(at, "key").join(far, "key", "left").join(turned, "key", "left").fillna(0, ["turning_pairs"])
    median, sharp, unique = F.col("m") / 1000, F.coalesce(F.col("near") / F.col("cost"), F.lit(0.0)), F.coalesce(F.col("far") / F.col("cost"), F.lit(float("inf")))
    reasons = [
        F.when(F.col("turning_pairs") < LEAST_TURNING, "few turns"), F.when(~F.coalesce(median <= MOST_RESIDUAL, F.lit(False)), "large residuals"),
        F.when(sharp < LEAST_SHARP, "no sharp minimum"), F.when(unique < LEAST_UNIQUE, "another lag fits as well"),
    ]
    reason = F.concat_ws("; ", *reasons)
    return j.select("key", F.round("lag_s", 3).alias("lag_s"), "sign", (reason == "").alias("confident"), reason.alias("reason"), "pairs", "turning_pairs", F.round(median, 3).alias("median_residual"), F.round(sharp, 3).alias("sharpness"), F.round(unique, 3).alias("uniqueness"))
