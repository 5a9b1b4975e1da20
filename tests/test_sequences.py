"""Split windows against plain ones; keyframes, streams, geodesy."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kestrelgrid.functions.geodesy import enu, utm_epsg, with_geodetic, wrap_degrees
from kestrelgrid.functions.rounding import steady
from kestrelgrid.operators.keyframes import Selector, select_keyframes
from kestrelgrid.operators.split_windows import carried, haloed, neighbours, numbered, running
from kestrelgrid.streaming.fusion import first_deliveries, height_votes, keyframes, voxel_fusion


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    times = {k: sorted(rnd.sample(range(-500, 4000), 300 if k == "hot" else 7)) for k in ("hot", "b", "c")}
    data = [(k, t, t // 100, rnd.choice([None, rnd.randrange(9)])) for k, ts in times.items() for t in ts] + [(None, 1, 0, 1), ("n", 1, None, 1)]
    return spark.createDataFrame(data, "k string, t bigint, bucket bigint, v bigint").cache()


def same(a, b, columns):
    x, y = ({tuple(str(c) for c in r) for r in df.select("k", "t", *columns).collect()} for df in (a, b))
    assert x == y and x


def test_neighbours(rows):
    w = Window.partitionBy("k").orderBy("t")
    plain = rows.where("k IS NOT NULL AND bucket IS NOT NULL").withColumns({"p": F.lag("t").over(w), "pv": F.lag("v").over(w), "n": F.lead("t").over(w)})
    got = neighbours(rows, ["k"], ["t"], "bucket", ["v"]).select("k", "t", F.col("prev.t").alias("p"), F.col("prev.v").alias("pv"), F.col("next.t").alias("n"))
    same(got, plain, ["p", "pv", "n"])


def test_carried_and_running(rows):
    known = rows.where("k IS NOT NULL AND bucket IS NOT NULL")
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    d = Window.partitionBy("k").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    same(carried(rows, ["k"], [F.col("t")], "bucket", {"l": F.col("v")}), known.withColumn("l", F.last("v", True).over(w)), ["l"])
    same(carried(rows, ["k"], [F.desc("t")], "bucket", {"l": F.col("v")}, forward=False), known.withColumn("l", F.last("v", True).over(d)), ["l"])
    same(running(rows, ["k"], ["t"], "bucket", {"s": F.col("v")}), known.withColumn("s", F.coalesce(F.sum("v").over(w), F.lit(0))), ["s"])


def test_halo(rows):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(-3, 2)
    n = numbered(rows, ["k"], ["t"], "bucket")
    h = haloed(n, ["k"], "i", 3, chunk=10)
    got = h.withColumn("m", F.max("v").over(Window.partitionBy("k", "run").orderBy("i").rowsBetween(-3, 2))).where("own")
    same(got, rows.where("k IS NOT NULL AND bucket IS NOT NULL").withColumn("m", F.max("v").over(w)), ["m"])


def test_empty(rows):
    none = rows.limit(0)
    assert neighbours(none, ["k"], ["t"], "bucket", ["v"]).count() == 0 and running(none, ["k"], ["t"], "bucket", {"s": F.col("v")}).count() == 0
    assert carried(none, ["k"], [F.col("t")], "bucket", {"l": F.col("v")}).count() == 0


def test_geodesy(spark):
    df = spark.createDataFrame([(47.3, 8.5, 500.0), (-33.9, 151.2, 20.0), (0.0, -179.9, 0.0), (None, 1.0, 1.0)], "lat double, lon double, alt double")
    o = [F.lit(47.0), F.lit(8.0), F.lit(0.0)]
    local = df.withColumns(dict(zip("enu", enu(F.col("lat"), F.col("lon"), F.col("alt"), *o))))
    for r in with_geodetic(local, F.col("e"), F.col("n"), F.col("u"), *o).where("lat IS NOT NULL").collect():
        assert abs(r.lat_deg - r.lat) < 1e-6 and abs((r.lon_deg - r.lon + 180) % 360 - 180) < 1e-6
    zones = spark.createDataFrame([(60.0, 5.0), (60.0, 2.0), (78.0, 10.0), (-45.0, 180.0), (85.0, 0.0), (-33.9, 151.2)], "lat double, lon double")
    assert [r[0] for r in zones.select(utm_epsg(F.col("lat"), F.col("lon"))).collect()] == [32632, 32631, 32633, 32760, None, 32756]
    a = spark.createDataFrame([(190.0,), (-190.0,), (180.0,), (540.0,)], "a double").select(wrap_degrees(F.col("a")), steady(F.col("a") / 7, 2)).collect()
    assert [r[0] for r in a] == [-170.0, 170.0, -180.0, -180.0] and a[1][1] == -27.14


def test_selector():
    s = Selector(baseline_m=5, turn_limit=30, least_sharp=10)
    assert s.take(0, 0, 0, 50) and not s.take(1000, 0, 3, 50) and s.take(2000, 0, 6, 50)
    assert not s.take(3000, 0, 12, 1)  # not sharp: passed over, the path flown is kept
    assert s.take(4000, 0, 13, 50)
    assert not s.take(4100, 6, 13, 50)  # a turn of 90 degrees in a tenth of a second
    assert not s.take(5000, 12, 13, None) and not s.take(5100, 18, 13, float("nan"))


FRAME = "flight_id string, frame_index bigint, t_ms bigint, x double, y double, sharp double"


def test_batch_and_stream_agree(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f, k, 500 * k, 2.0 * k + rnd.random(), rnd.random(), rnd.random() * 60) for f in ("a", "b") for k in range(200)] + [(None, 1, 1, 1.0, 1.0, 50.0), ("a", 900, 1, None, 1.0, 50.0)]
    df = spark.createDataFrame(rows, FRAME)
    batch = {(r.flight_id, r.frame_index) for r in select_keyframes(df).collect()}
    assert len(batch) > 20
    at = dt.datetime(2025, 1, 1)
    for part in range(4):
        lo, hi = part * 25_000, (part + 1) * 25_000
        df.where((F.col("t_ms") >= lo) & (F.col("t_ms") < hi)).withColumn("received_at", F.lit(at + dt.timedelta(minutes=part)).cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{FRAME}, received_at timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = keyframes(stream).writeStream.format("memory").queryName("keyframes_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {(r.flight_id, r.frame_index) for r in spark.sql("SELECT * FROM keyframes_out").collect()} == batch
    finally:
        q.stop()


POINT = "flight_id string, sample_id bigint, x double, y double, z double, acc double, view bigint, received_at timestamp"


def test_streaming_fusion(spark, tmp_path):
    at = dt.datetime(2025, 1, 1, 0, 30)
    rows = [("a", k, 0.1 * (k % 3), 0.2, 0.3, None, k % 2, at) for k in range(10)] + [("a", 3, 0.0, 0.2, 0.3, None, 1, at)]
    spark.createDataFrame(rows, POINT).coalesce(1).write.parquet(str(tmp_path / "in"))
    late = [("a", 99, 0.0, 0.2, 0.3, None, 1, at + dt.timedelta(days=10))]
    outputs = {"voxels": (voxel_fusion, "append"), "votes": (height_votes, "append"), "firsts": (first_deliveries, "append")}
    for name, (make, mode) in outputs.items():
        folder = tmp_path / name
        spark.createDataFrame(rows, POINT).coalesce(1).write.parquet(str(folder))
        stream = spark.readStream.schema(POINT).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
        try:
            q.processAllAvailable()
            spark.createDataFrame(late, POINT).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        finally:
            q.stop()
    v = spark.sql("SELECT * FROM voxels").collect()
    assert [(r.n, r.views) for r in v] == [(11, 2)]
    assert sorted(r.n for r in spark.sql("SELECT * FROM votes").collect()) == [5, 6]
    assert spark.sql("SELECT * FROM firsts").count() == 11
