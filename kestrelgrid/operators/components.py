"""Connected components by hooking and shortcutting, with lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where the session names none, a folder of this machine is set if all tasks run on it, as in tests; on a cluster that is an
    error, as executors could not read it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a bigint, b bigint), in any direction. Result: (v, component): the smallest vertex it is connected with.

    Every round a vertex takes the smallest label around it and then its label's label, so chains of any length are done
    in a number of rounds that grows with their logarithm or little more. NULLs and repeated edges: no effect; a loop
    makes its vertex a component.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b").distinct()
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c"))
    for _ in range(rounds):
        near = both.join(label.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        hooked = label.join(near, "v").select("v", "c", F.least("c", "m").alias("m"))
        # a root that a member can leave for a smaller one takes its members along
        roots = hooked.groupBy("c").agg(F.min("m").alias("r"))
        moved = hooked.join(roots, "c").select("v", "c", F.least("m", "r").alias("m"))
        jump = moved.select(F.col("v").alias("m"), F.col("m").alias("mm"))
        new = checkpointed(moved.join(jump, "m", "left").select("v", "c", F.least("m", F.coalesce("mm", "m")).alias("n")))
        changed = new.where("n <> c").limit(1).count()
        label = new.select("v", F.col("n").alias("c"))
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label.select("v", F.col("c").alias("component"))
