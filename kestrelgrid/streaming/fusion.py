"""Running operators over streams of telemetry points.

The reference keeps such state for ever; here it ends. ``watermarked`` lets late rows in for a stated time, after which a
window's state is written out and dropped, so state is bounded by the windows that are open.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrelgrid.operators.grid import voxel
from kestrelgrid.operators.keyframes import Selector


def voxel_fusion(points: DataFrame, *, size: float = 2.0, window: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Mean position, count and the views as bits of a word of 64 of each voxel and window of ``received_at``.

    points: a stream (flight_id, x, y, z, view, received_at timestamp). Emits a window when the watermark has passed it
    (append), or every change (update).
    """
    v = {f"i{a}": voxel(a, size) for a in "xyz"}
    bit = F.expr("shiftleft(1L, CAST(pmod(view, 64) AS INT))")
    grouped = points.withWatermark("received_at", late).withColumns(v).groupBy(F.window("received_at", window).alias("w"), "flight_id", *v)
    return grouped.agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"), F.bit_count(F.bit_or(bit)).alias("views")).select("flight_id", *v, "x", "y", "z", "n", "views", F.col("w.end").alias("window_end"))


def height_votes(points: DataFrame, *, cell: float = 5.0, window: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Weighted mean height of each cell, view and window: the votes that consensus() counts at readout."""
    c = {f"i{a}": voxel(a, cell) for a in "xy"}
    w = 1 / (1 + F.coalesce("acc", F.lit(2.0)) * F.coalesce("acc", F.lit(2.0)))
    grouped = points.withWatermark("received_at", late).withColumns(c).withColumn("w8", w).groupBy(F.window("received_at", window).alias("w"), "flight_id", *c, "view")
    return grouped.agg((F.sum(F.col("z") * F.col("w8")) / F.sum("w8")).alias("z"), F.count("*").alias("n")).select("flight_id", *c, "view", "z", "n", F.col("w.end").alias("window_end"))


def first_deliveries(points: DataFrame, late: str = "3 days") -> DataFrame:
    """Rows once, however often they are delivered within ``late``."""
    return points.withWatermark("received_at", late).dropDuplicatesWithinWatermark(["flight_id", "sample_id"])


def keyframes(frames: DataFrame, *, idle: str = "1 hour", late: str = "10 minutes", **limits: float) -> DataFrame:
    """The streaming twin of select_keyframes(): frames of a flight in the order they come, sorted inside a batch.

    frames: a stream (flight_id, frame_index, t_ms, x, y, sharp, received_at). A flight's state is dropped when nothing
    came for ``idle``, in event time.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        if held.get("last"):
            held["last"] = tuple(held["last"])
        selector = Selector(**(limits | held))
        latest = None
        for batch in batches:
            batch = batch.sort_values(["t_ms", "frame_index"])
            kept = [selector.take(int(r.t_ms), r.x, r.y, r.sharp) for r in batch.itertuples(index=False)]
            top = batch["received_at"].max()
            latest = top if latest is None or top > latest else latest
            yield batch.loc[kept, ["flight_id", "frame_index", "t_ms"]]
        state.update((json.dumps(asdict(selector)),))
        if latest is not None and not pd.isna(latest):
            state.setTimeoutTimestamp(max(int(latest.timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)

    known = frames.where("flight_id IS NOT NULL AND t_ms IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").withWatermark("received_at", late)
    return known.groupBy("flight_id").applyInPandasWithState(run, "flight_id string, frame_index bigint, t_ms bigint", "selector string", "append", GroupStateTimeout.EventTimeTimeout)
