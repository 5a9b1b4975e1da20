import datetime as dt
import random

import pytest

from kestrelgrid.functions.field_names import quantity_of
from kestrelgrid.operators.schema_drift import field_forms, schema_changes, typed_records

FILE = "file_id bigint, producer string, log_stream string, flight_id string, layout string, written_at timestamp_ntz, payload string, path string"


def files(spark, rows):
    day = dt.datetime(2025, 1, 30)
    return spark.createDataFrame([(i, p, "telemetry", "f", layout, day + dt.timedelta(days=d), text, "x") for i, p, layout, d, text in rows], FILE)


@pytest.mark.parametrize("name, quantity", [("Latitude", "latitude"), ("position.lat", "latitude"), ("altitude_above_seaLevel(feet)", "alt_msl"), ("hAcc(mm)", "accuracy_h"), ("isVideo", "is_video"), ("Time Stamp", "time"), ("altMSL", "alt_msl"), ("durationSec", "duration"), ("foo Bar", "foo_bar")])
def test_quantities(name, quantity):
    assert quantity_of(name) == quantity


def test_changes_across_months(spark):
    rows = [
        (5, "p", "csv", 0, "t,lat,n_sats\n1.5,2.0,5\n"),
        (4, "p", "csv", 1, "t,Latitude,n_sats,foo\n1.5,2.0,,\n"),  # renamed, added, n_sats without form
        (3, "p", "jsonl", 40, '{"t": 1.5, "Latitude": "2N", "n_sats": 5.0}\n{"t": null, "is": {"deep": true}}\n'),  # retyped, removed foo, added nested
        (2, "p", "jsonl", 41, '{"t": 1, "lat": 2.5}\nnot json\n'),  # renamed and retyped, removed
        (9, "q", "csv", 0, "a;b\n1;2\n"), (8, "q", "csv", 0, None), (1, "p", "csv", 0, "t,lat,n_sats\n1.5,2.0,5\n"),
    ]
    df = files(spark, rows + rows[:2])
    got = {tuple(r) for r in schema_changes(df).collect()}
    assert len(got) == schema_changes(df).count()
    assert got == {
        (4, "renamed", "lat", "Latitude"), (4, "added", "", "foo"),
        (3, "removed", "foo", ""), (3, "added", "", "is.deep"), (3, "retyped", "Latitude", "Latitude"), (3, "retyped", "n_sats", "n_sats"),
        (2, "renamed", "Latitude", "lat"), (2, "retyped", "Latitude", "lat"), (2, "removed", "n_sats", ""), (2, "removed", "is.deep", ""), (2, "retyped", "t", "t"),
        (9, "added", "", "a"), (9, "added", "", "b"),
    }


def test_runs_of_files_say_the_same(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for k in range(40):
        names = [n for n in ("t", "lat", "Latitude", "n_sats", "foo", "bar") if rnd.random() < 0.6]
        rows.append((k, "pq"[k % 2], "csv", rnd.randrange(90), ",".join(names) + "\n" + ",".join(rnd.choice(["1", "1.5", "x", ""]) for _ in names) + "\n"))
    df = files(spark, rows)
    whole = sorted(tuple(r) for r in schema_changes(df).collect())
    for size in (1, 3):
        monkeypatch.setattr("kestrelgrid.operators.schema_drift.RUN", size)
        assert sorted(tuple(r) for r in schema_changes(df).collect()) == whole and len(whole) > 50


def test_forms_and_empty(spark):
    df = files(spark, [(1, None, "csv", 0, "a,b,c,d\n1,1,true,x\n2.,2,false,1\n\n,,,\n")])
    assert {r.path: (r.form, r.n_values) for r in field_forms(df).collect()} == {"a": ("decimal", 2), "b": ("integer", 2), "c": ("boolean", 2), "d": ("string", 2)}
    assert schema_changes(df).count() == 0 and schema_changes(df.limit(0)).count() == 0 and field_forms(df.limit(0)).count() == 0


def test_two_names_of_one_quantity(spark):
    df = files(spark, [(1, "p", "csv", 0, "lat\n1\n"), (2, "p", "csv", 1, "lat,Latitude\n1,2\n")])
    assert len({(r.file_id, r.quantity) for r in field_forms(df).collect()}) == 3


def test_typed(spark):
    text = "time(millisecond),lat,altitude_above_seaLevel(feet),isVideo,n_sats\n1500,2.5S,10,rec,7\n00:00:02.250,4N,3.5 m,0,2 of 9\nsoon,x,?,maybe,many\n"
    kinds = {"time": "seconds", "latitude": "degrees", "alt_msl": "metres", "is_video": "flag", "satellites": "count"}
    rows = typed_records(files(spark, [(1, "p", "csv", 0, text)] * 2), kinds).orderBy("rec_no").collect()
    assert [(r.time, r.latitude, r.alt_msl and round(r.alt_msl, 4), r.is_video, r.satellites) for r in rows] == [(1.5, -2.5, 3.048, True, 7), (2.25, 4.0, 3.5, False, 2), (None, None, None, None, None)]
    assert [f.quantity for f in rows[2].failed] == list(kinds) and rows[0].failed == []


def test_long_cells_and_odd_payloads(spark):
    long, deep = "x" * 300_000, "[" * 100_000
    rows = [(1, "p", "csv", 0, f"a,b\r\n{long},1\r\n"), (2, "p", "jsonl", 1, f'{deep}\n{{"a": "{long}", "b": [1, 2]}}\n'), (3, "p", "csv", 2, "\n\n"), (4, "p", "csv", 3, 'a,"b\n'), (5, "p", None, 4, '{"a": "\u2028"}')]
    got = {(r.file_id, r.path): r.form for r in field_forms(files(spark, rows)).collect()}
    assert got[1, "a"] == "string" and got[1, "b"] == "integer" and got[2, "a"] == "string" and got[2, "b"] == "string" and (4, "a") in got and not [k for k in got if k[0] == 3]
    assert schema_changes(files(spark, rows)).count() > 0


def test_renames_of_names_in_no_table(spark):
    rnd = random.Random(8)

    def payload(names, start, tilt="decimal"):
        rows = [(f"{start + k * 0.2:.2f}", f"{rnd.uniform(40, 60):.1f}", rnd.choice(["calm", "gusty", "windy"]), f"{rnd.uniform(-5, 5):.3f}" if tilt == "decimal" else str(rnd.randrange(-5, 5))) for k in range(40)]
        return ",".join(names) + "\n" + "\n".join(map(",".join, rows)) + "\n"

    rows = [
        (1, "p", "csv", 0, payload(["t", "battery_pct", "air", "tilt_a"], 0)),
        (2, "p", "csv", 1, payload(["t", "charge_left", "weather_word", "tilt_b"], 500)),
        (3, "p", "csv", 2, payload(["t", "charge_left", "weather_word", "tilt_c"], 900, "integer")),
        (4, "p", "csv", 3, payload(["t", "charge_left", "weather_word", "lat"], 900)),  # a name of another quantity: the profile tells
        (5, "p", "csv", 4, payload(["t", "charge_left", "weather_word", "lon"], 900)),  # two names of two quantities: never one field
    ]
    assert {tuple(r) for r in schema_changes(files(spark, rows)).collect()} == {
        (2, "renamed", "battery_pct", "charge_left"), (2, "renamed", "air", "weather_word"), (2, "renamed", "tilt_a", "tilt_b"),
        (3, "renamed", "tilt_b", "tilt_c"), (3, "retyped", "tilt_b", "tilt_c"), (4, "renamed", "tilt_c", "lat"), (4, "retyped", "tilt_c", "lat"), (5, "removed", "lat", ""), (5, "added", "", "lon"),
    }
