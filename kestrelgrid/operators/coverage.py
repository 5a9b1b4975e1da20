"""Views chosen greedily by what they add, in the order of flight, and how often boxes of cells cover the ground.

A view is kept if at least ``least_new`` of its footprint has been seen by fewer than ``target`` kept views. The choice is
sequential, so a flight is read by one task as a stream of sorted batches; the state is a count for each cell kept views
have seen, bounded by the ground a flight covers, not by its views.

Views without cells: not kept. NULL flights, views or cells: left out. Repeated cells of a view count once.

Boxes are counted without their cells: a box is its four corners, and between two neighbouring corners nothing changes, so
a box of a million million cells costs what a box of one does. A flight's corners are read by one task, in stretches of
bounded size from west to east; what is carried on is a step for each row in which boxes are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_views(footprints: DataFrame, *, target: int = 3, least_new: float = 0.4) -> DataFrame:
    """footprints: (flight_id, view, i, j), a row a cell. Result: (flight_id, view, new, cells) of the views kept."""
    known = footprints.where("flight_id IS NOT NULL AND view IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL")
    views = known.groupBy("flight_id", "view").agg(F.collect_set(F.concat_ws(":", "i", "j")).alias("cells"))
    ordered = views.repartition("flight_id").sortWithinPartitions("flight_id", "view")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flight, seen = None, {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.flight_id != flight:
                    flight, seen = row.flight_id, {}
                new = sum(seen.get(c, 0) < target for c in row.cells)
                if new >= least_new * len(row.cells):
                    for c in row.cells:
                        seen[c] = seen.get(c, 0) + 1
                    out.append((row.flight_id, row.view, new, len(row.cells)))
            yield pd.DataFrame(out, columns=["flight_id", "view", "new", "cells"])

    return ordered.mapInPandas(run, "flight_id string, view bigint, new bigint, cells bigint")


def box_depths(boxes: DataFrame) -> DataFrame:
    """boxes: (flight_id, lox, hix, loy, hiy), whole cells with both ends. Result: (flight_id, seen, n): n cells lie in just ``seen`` boxes, one at least."""
    west, east, south, north = F.col("lox"), F.col("hix") + 1, F.col("loy"), F.col("hiy") + 1
    corner = lambda x, y, d: F.struct(x.alias("x"), y.alias("y"), F.lit(d).alias("d"))
    corners = boxes.select("flight_id", F.inline(F.array(corner(west, south, 1), corner(east, south, -1), corner(west, north, -1), corner(east, north, 1))))
    steps = corners.groupBy("flight_id", "x", "y").agg(F.sum("d").alias("d")).where("d <> 0")

    def run(key: tuple[pa.Scalar, ...], steps: pa.Table) -> pa.Table:
        n = cells_by_depth(*(steps[c].to_numpy() for c in "xyd"))
        seen = np.flatnonzero(n)
        return pa.table({"flight_id": pa.array([key[0].as_py()] * len(seen), pa.string()), "seen": seen.astype(np.int64), "n": n[seen]})

    return steps.groupBy("flight_id").applyInArrow(run, "flight_id string, seen bigint, n bigint")


def cells_by_depth(x: np.ndarray, y: np.ndarray, d: np.ndarray, most: int = 2_000_000) -> np.ndarray:
    """How many cells have each depth, 0 apart; a cell's depth is the sum of d over the corners that are neither east nor north of it. ``most``: numbers held at once, but for a stretch of one column."""
    if len(x) and (int(x.max()) - int(x.min())) * (int(y.max()) - int(y.min())) >= 2**63:
        raise OverflowError("boxes around more cells than a bigint counts")
    order = np.argsort(x, kind="stable")
    x, y, d = x[order], y[order], d[order]
    xs, first = np.unique(x, return_index=True)
    total, open_y, open_d, at = np.zeros(d[d > 0].sum() + 1, np.int64), y[:0], d[:0], 0
    while at < len(xs) - 1:  # beyond the last corner nothing is open
        ends = np.append(first, len(x))[at + 1 : min(at + 1025, len(xs))]
        k = max(1, int(np.searchsorted(np.arange(1, len(ends) + 1) * (len(open_y) + ends - first[at]), most, "right")))
        part = slice(first[at], ends[k - 1])
        ys, col = np.unique(np.concatenate([open_y, y[part]]), return_inverse=True)
        row = np.concatenate([np.zeros(len(open_y), np.int64), np.searchsorted(xs, x[part]) - at])
        grid = np.bincount(row * len(ys) + col, np.concatenate([open_d, d[part]]), k * len(ys)).astype(np.int64).reshape(k, -1)
        np.cumsum(grid, axis=0, out=grid)
        open_y, open_d = ys[grid[-1] != 0], grid[-1][grid[-1] != 0]
        np.cumsum(grid, axis=1, out=grid)
        np.add.at(total, grid[:, :-1].ravel(), np.outer(np.diff(xs[at : at + k + 1]), np.diff(ys)).ravel())
        at += k
    total[0] = 0
    return total
