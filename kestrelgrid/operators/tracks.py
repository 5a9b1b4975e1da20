"""Matches between pictures chained into tracks in which no picture has two places.

A track is what matches connect, unless that would give one picture two of its places: then matches are taken one by one in
their order, and one that would is left out. Only connected sets with such a picture need an order; all others are tracks as
they are, without being gathered. A set with a conflict is one task's work: it is what a few wrong matches connect, and it is
read as edges, two numbers each.

Defined results
---------------
* NULLs: not used. Repeated matches: no effect. A track has two places or more. Empty tables: no rows.
* The name of a track is its lowest (frame, key).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrelgrid.operators.components import components


def build_tracks(matches: DataFrame) -> DataFrame:
    """matches: (fa int, ka bigint, fb int, kb bigint, place bigint), frames and keys not below 0 and keys under 2^40. Result: (track, frame, key)."""
    m = matches.where("fa IS NOT NULL AND ka IS NOT NULL AND fb IS NOT NULL AND kb IS NOT NULL").groupBy("fa", "ka", "fb", "kb").agg(F.min("place").alias("place"))
    name = lambda f, k: F.col(f).cast("bigint") * (1 << 40) + F.col(k)
    edges = m.select(name("fa", "ka").alias("a"), name("fb", "kb").alias("b"), "place")
    of = components(edges.select("a", "b")).select("v", "component")
    frame = F.shiftright("v", 40)
    crowded = of.groupBy("component", frame.alias("frame")).agg(F.count("*").alias("n")).where("n > 1").select("component").distinct()
    plain = of.join(crowded, "component", "left_anti").select("v", F.col("component").alias("track"))
    torn = edges.join(of.withColumnRenamed("v", "a"), "a").join(crowded, "component", "left_semi")

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}
        held: dict[int, dict[int, int]] = {}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for a, b in rows.sort_values(["place", "a", "b"])[["a", "b"]].itertuples(index=False):
            for v in (a, b):
                if v not in root:
                    root[v], held[v] = v, {v >> 40: v}
            x, y = find(a), find(b)
            if x == y:
                continue
            if len(held[x]) < len(held[y]):
                x, y = y, x
            if all(held[x].get(f, v) == v for f, v in held[y].items()):
                held[x].update(held.pop(y))
                root[y] = x
        return pd.DataFrame([(v, min(places.values())) for places in held.values() for v in places.values()], columns=["v", "track"])

    parted = torn.groupBy("component").applyInPandas(chain, "v bigint, track bigint")
    every = plain.unionByName(parted)
    whole = every.groupBy("track").agg(F.count("*").alias("n")).where("n > 1").select("track")
    return every.join(whole, "track", "left_semi").select("track", F.shiftright("v", 40).cast("int").alias("frame"), F.col("v").bitwiseAND(F.lit((1 << 40) - 1)).alias("key"))
