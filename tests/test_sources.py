import json

import pytest
from pyspark.sql import functions as F

from kestrelgrid.sources.logs import candidates, check_control_network, first_candidates, load_logs, read_control_points, read_csv_logs, read_gpx, read_srt
from kestrelgrid.sources.writers import geojson_features, kml_placemarks, read_ply, write_measurements, write_ply, write_xyz


def test_srt(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes(
        b"1\r\n00:00:01,500 --> 00:00:02,000\r\n<font size=\"28\">[latitude: 47.5] [longitude: -8.25] [rel_alt: 10.5 abs_alt: 410.0] [focal_len: 24.0] 2025-01-02 03:04:05.678</font>\r\n\r\n"
        b"2\n01:00:00.040 --> x\nlatitude: 1\n\n3\nno time line [latitude: 9]\n"
    )
    rows = read_srt(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.t, r.latitude, r.longitude, r.alt_rel, r.alt_msl, r.focal_len) for r in rows] == [(1.5, 47.5, -8.25, 10.5, 410.0, 24.0), (3600.04, 1.0, None, None, None, None)]
    assert rows[0].wallclock == "2025-01-02 03:04:05.678"


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time(millisecond),latitude,longitude,altitude_above_seaLevel(feet),isVideo\n1500,1,2,100,1\n")
    (tmp_path / "b.csv").write_text("t_s;lat;lng;hAcc(mm)\n2.5;3;4W;250\n")
    rows = sorted(read_csv_logs(spark, str(tmp_path)).collect(), key=lambda r: r.time)
    assert (rows[0].time, rows[0].alt_msl, rows[0].is_video) == (1.5, pytest.approx(30.48), True)
    assert (rows[1].time, rows[1].latitude, rows[1].longitude, rows[1].accuracy_h, rows[1].is_video) == (2.5, 3.0, -4.0, 0.25, None)


def test_gpx(spark, tmp_path):
    (tmp_path / "a.gpx").write_text(
        '<gpx><trk><trkseg><trkpt lat="1.0" lon="2.0"><ele>5</ele><time>2025-01-01T00:00:10Z</time></trkpt><trkpt lat="1.5" lon="2.5"><time>2025-01-01T00:00:12.500Z</time></trkpt><trkpt lat="9" lon="9"></trkpt></trkseg></trk></gpx>'
    )
    assert [(r.t, r.latitude, r.alt_msl) for r in read_gpx(spark, str(tmp_path)).orderBy("t").collect()] == [(0.0, 1.0, 5.0), (2.5, 1.5, 0.0)]


def test_names_by_trust(spark, tmp_path):
    headers = ["height", "lat", "Latitude", "compass_heading(degrees)", "gimbal_yaw", "altitude_above_seaLevel(feet)", "odd"]
    assert candidates(headers) == {"latitude": ["Latitude", "lat"], "alt_rel": ["height"], "yaw": ["gimbal_yaw", "compass_heading(degrees)"], "alt_msl": ["altitude_above_seaLevel(feet)"]}
    assert first_candidates(headers)["yaw"] == "gimbal_yaw" and candidates([]) == {}
    (tmp_path / "a.csv").write_text("time_s,lat,Latitude,compass_heading,gimbal_yaw\n1,5,,10,\n2,5,6,10,20\n")
    assert [(r.latitude, r.yaw) for r in read_csv_logs(spark, str(tmp_path)).orderBy("time").collect()] == [(5.0, 10.0), (6.0, 20.0)]


def test_way_points(spark, tmp_path):
    (tmp_path / "w.gpx").write_text('<gpx><wpt lon="2" lat="1"><time>2025-01-01T00:00:00Z</time><ele>7</ele></wpt><wpt lat="1.5" lon="2.5"/></gpx>')
    assert [(r.t, r.latitude, r.longitude, r.alt_msl) for r in read_gpx(spark, str(tmp_path)).collect()] == [(0.0, 1.0, 2.0, 7.0)]


def test_logs_of_any_kind(spark, tmp_path):
    flags = "\n".join(f"{k},1,2,{int(100 <= k <= 160 or 300 <= k < 320)}" for k in range(0, 400, 2))
    (tmp_path / "a.csv").write_text("time_s,lat,lon,isVideo\n" + flags + "\n")
    (tmp_path / "b.csv").write_text("video_time_s,lat,lon\n0,1,2\n30,1,2\n")
    (tmp_path / "c.log").write_text("1\n00:00:05,500 --> 00:00:06,000\n[latitude: 1] [longitude: 2]\n")
    (tmp_path / "d.txt").write_text('<?xml version="1.0"?><gpx><trkpt lat="1" lon="2"><time>2025-01-01T00:00:00Z</time></trkpt></gpx>')
    df = load_logs(spark, str(tmp_path), video_s=60.0)
    got = {r.file[-5:]: (r.format, r.offset_s, r.offset_source, r.first, r.coverage) for r in df.groupBy("file", "format", "offset_s", "offset_source", "coverage").agg(F.min("t").alias("first")).collect()}
    assert got == {"a.csv": ("csv", 100.0, "recording_flag", -100.0, 1.0), "b.csv": ("csv", 0.0, "video_clock", 0.0, 0.5), "c.log": ("srt", 0.0, "assumed_zero", 5.5, 0.0), "d.txt": ("gpx", 0.0, "assumed_zero", 0.0, 0.0)}
    assert {r.offset_source for r in load_logs(spark, str(tmp_path), offset_s=2.5).collect()} == {"explicit"}
    assert {r.offset_source for r in load_logs(spark, str(tmp_path / "a.csv")).collect()} == {"assumed_zero"}


def survey(*ids, lat=1.0):
    point = lambda i: {"id": i, "local_xyz": [1.0, 2.0, 3.0], "geo": {"lat": lat, "lon": 2.0, "alt_msl": 3.0}}
    return json.dumps({"coordinate_frame": "reconstruction_local_m", "measurement_set_id": "m", "controls": [point(i) for i in ids], "checkpoints": [point("c")]})


def test_control_points(spark, tmp_path):
    (tmp_path / "a.json").write_text(survey("p", "q"))
    assert {(r.role, r.id, r.x) for r in read_control_points(spark, str(tmp_path / "a.json")).collect()} == {("control", "p", 1.0), ("control", "q", 1.0), ("checkpoint", "c", 1.0)}
    for k, text in enumerate((survey("c"), survey("p", lat=91.0))):
        (tmp_path / f"bad{k}.json").write_text(text)
        with pytest.raises(ValueError):
            read_control_points(spark, str(tmp_path / f"bad{k}.json"))


def test_control_networks(spark):
    schema = "file string, measurement_set_id string, role string, id string, x double, y double, z double, lat double, lon double, alt double"
    net = [("f", "m", "control", "a", 0.0, 0.0, 0.0, 47.0, 8.0, 400.0), ("f", "m", "control", "b", 100.0, 0.0, 0.0, 47.0, 8.001, 400.0), ("f", "m", "control", "c", 0.0, 100.0, 1.0, 47.001, 8.0, 401.0), ("f", "m", "checkpoint", "d", 50.0, 50.0, 0.0, 47.0005, 8.0005, 400.0)]
    check = lambda rows: check_control_network(spark.createDataFrame(rows, schema))
    check(net)
    check([])
    moved = lambda k, **new: [tuple({**dict(zip([c.split()[0] for c in schema.split(", ")], r)), **new}.values()) if i == k else r for i, r in enumerate(net)]
    for bad in (net[:2] + net[3:], net[3:], moved(2, x=50.0, y=0.0, z=0.0), moved(2, lat=47.0, lon=8.0, alt=400.0), moved(3, x=0.0, y=0.0, z=5e-9), moved(3, lat=47.0, lon=8.0, alt=400.00005)):
        with pytest.raises(ValueError):
            check(bad)


def test_point_files(spark, tmp_path):
    p = spark.createDataFrame([(1.5, 2.0, -3.25, 2), (0.0, 0.0, 0.0, None)], "x double, y double, z double, confidence int")
    write_xyz(p, str(tmp_path / "xyz"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "xyz")).collect()) == ["0.000 0.000 0.000", "1.500 2.000 -3.250"]
    write_ply(p, str(tmp_path / "ply"))
    assert {tuple(r) for r in read_ply(spark, str(tmp_path / "ply")).collect()} == {(1.5, 2.0, -3.25, 2), (0.0, 0.0, 0.0, 0)}


def test_measurements(spark, tmp_path):
    rows = [("point", [(1.0, 2.0, 3.0)], 0.0, "m", "a&b"), ("area", [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0)], 0.5, "m2", None), ("distance", [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], 1.0, "m", "d")]
    m = spark.createDataFrame(rows, "kind string, points array<struct<lon:double,lat:double,alt:double>>, value double, unit string, label string")
    shapes = [json.loads(r.value)["geometry"] for r in geojson_features(m).collect()]
    assert [s["type"] for s in shapes] == ["Point", "Polygon", "LineString"] and shapes[1]["coordinates"][0][0] == shapes[1]["coordinates"][0][-1]
    assert "<name>a&amp;b</name>" in kml_placemarks(m.where(F.col("kind") == "point")).first().value
    write_measurements(m, str(tmp_path / "k"), "kml")
    with pytest.raises(ValueError):
        write_measurements(m, str(tmp_path / "x"), "dxf")
