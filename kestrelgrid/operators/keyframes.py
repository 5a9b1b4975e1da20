"""Keyframes by a single pass along each flight, with state of fixed size.

A frame is taken when the path flown since the last one taken reaches ``baseline_m``, the course is not turning faster
than ``turn_limit`` and the frame is sharp enough: at least ``least_sharp``, and half the median of the last ``ring``
frames once there are five. A frame that is not sharp, or turns, is passed over without forgetting the path flown.

The pass is inherently sequential, so a flight is read by one task, but as a stream of sorted batches: what is held is the
state, not the flight. The same Selector keeps the state of the streaming twin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame


@dataclass
class Selector:
    baseline_m: float = 8.0
    turn_limit: float = 20.0
    least_sharp: float = 20.0
    ring: int = 15
    flown: float = 0.0
    last: tuple | None = None
    course: float | None = None
    scores: list = field(default_factory=list)
    any_taken: bool = False

    def take(self, t_ms: int, x: float, y: float, sharp: float | None) -> bool:
        """Whether the next frame is a keyframe."""
        rate = 0.0
        if self.last is not None:
            dx, dy, dt = x - self.last[1], y - self.last[2], (t_ms - self.last[0]) / 1000
            step = math.hypot(dx, dy)
            self.flown += step
            if step > 0.05:
                course = math.degrees(math.atan2(dx, dy))
                if self.course is not None and dt > 0:
                    rate = abs((course - self.course + 180) % 360 - 180) / dt
                self.course = course
        self.last = (t_ms, x, y)
        floor = max(self.least_sharp, 0.5 * median(self.scores)) if len(self.scores) >= 5 else self.least_sharp
        known = sharp is not None and not math.isnan(sharp)
        if known:
            self.scores = [*self.scores[-self.ring + 1 :], sharp]
        if (self.any_taken and self.flown < self.baseline_m) or rate > self.turn_limit or not known or sharp < floor:
            return False
        self.flown, self.any_taken = 0.0, True
        return True


def select_keyframes(frames: DataFrame, **limits: float) -> DataFrame:
    """frames: (flight_id, frame_index, t_ms, x, y, sharp). Result: (flight_id, frame_index, t_ms) of the keyframes.

    Frames without a position are passed over. NULL flights: no rows. Equal times: in the order of frame_index.
    """
    asked = frames.where("flight_id IS NOT NULL AND t_ms IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    ordered = asked.select("flight_id", "frame_index", "t_ms", "x", "y", "sharp").repartition("flight_id").sortWithinPartitions("flight_id", "t_ms", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flight, state = None, Selector(**limits)
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                if row.flight_id != flight:
                    flight, state = row.flight_id, Selector(**limits)
                kept.append(state.take(row.t_ms, row.x, row.y, row.sharp))
            yield batch.loc[kept, ["flight_id", "frame_index", "t_ms"]]

    return ordered.mapInPandas(run, "flight_id string, frame_index bigint, t_ms bigint")
