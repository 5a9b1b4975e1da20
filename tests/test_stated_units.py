import random

from kestrelgrid.operators.stated_units import to_millimetres

CELL = "id bigint, axis string, source string, header string, cell string, unit_text string, note string, value int"


def values(spark, rows, sources=()):
    cells = spark.createDataFrame([(k, "h", *r, 0) for k, r in enumerate(rows)], CELL)
    return {r.id: (r.mm, r.stated_in) for r in to_millimetres(cells, spark.createDataFrame(list(sources), "source string, description string, note string")).collect()}


def test_nearest_statement_holds(spark):
    rows = [
        ("s", "h_acc(cm)", "12 mm", "ft", "accuracies in feet"), ("s", "h_acc(cm)", "12", "ft", "accuracies in feet"), ("s", "h_acc", "12", "FT", None), ("s", "h_acc", "2,5", None, "H/V error: twelfths of a foot"),
        ("s", "h_acc", "12", None, "mast moved 3 m"), ("t", "h_acc", "1.25", None, None), (None, None, "1.25", None, None),
    ]
    got = values(spark, rows, [("s", "Base kit B. Accuracy: hundredths of a metre. Mast height in feet.", ""), ("t", "Handheld logger, no data sheet.", ""), (None, "Accuracy: feet", "")])
    assert got == {0: (12, "cell"), 1: (120, "header"), 2: (3658, "row"), 3: (64, "row"), 4: (120, "source"), 5: (1250, "default"), 6: (1250, "default")}


def test_notations(spark):
    good = {"± 5,25 FT.": 1600, '3"': 76, " 9 ": 9000, "1.5e+2 (Cm)": 1500, "0.4 µm": 0, ".5 m": 500, "2 [yd]": 1829, "0,0005": 1, "999.9999": 1_000_000}
    got = values(spark, [("s", "h", cell, None, None) for cell in good])
    assert [got[k][0] for k in range(len(good))] == list(good.values())
    bad = [None, "", "  ", "--", "n/a", "nan", "inf", "####", "-3", "0", "1000", "HDOP 1.2", "12 sats", "snr 40", "no fix", "1 km", "5 bananas", "x" * 100_000]
    assert values(spark, [("s", "h", cell, None, None) for cell in bad]) == {}


def test_repeats_and_empty(spark):
    cells = spark.createDataFrame([(1, "h", "s", "h", "2", None, None, 0)] * 3, CELL)
    none = spark.createDataFrame([], "source string, description string")
    assert [r.mm for r in to_millimetres(cells, none).collect()] == [2000]
    assert to_millimetres(cells.limit(0), none).count() == 0


def test_amounts_of_units(spark):
    said = {
        "accuracies in thousandths of a metre": 1, "1-sigma, 1/100 m": 10, "Genauigkeit in lengths of three feet": 914, "H/V error: thousands of metres": 1_000_000, "acc. cols = tenths of a metre, altitude in feet": 100,
        "logged 12 sats; error given in twelfths of a foot": 25, "accuracies in international feet": 305, "Precision: quarters of an inch since 2019": 6, "windy": 1000, "altitude in feet": 1000,
    }
    got = values(spark, [("s", "h", "1" if mm < 1_000_000 else "0.5", None, note) for note, mm in said.items()])
    assert [got[k][0] for k in range(len(said))] == [mm if mm < 1_000_000 else 500_000 for mm in said.values()]


def test_unseen_phrases_get_their_unit_from_the_graph(spark):
    rnd = random.Random(4)
    true = [rnd.lognormvariate(8, 0.5) for _ in range(400)]  # mm
    rows = [("s", "h_acc", f"{mm / 10:.4f}", "cm", None) if k % 2 else ("s", "h_acc", f"{mm / 304.8:.4f}", None, "spread figures come in surveyors' ells") for k, mm in enumerate(true)]
    rows += [("s", "h_acc", "9 sats", None, None)] * 20 + [("s", "h(true north)", f"{true[0] / 304.8:.4f}", None, "error: surveyors' ells")]
    got = values(spark, rows)
    assert all(abs(got[k][0] - mm) <= 1 for k, mm in enumerate(true)) and got[0][1] == "row"
    assert not any(k in got for k in range(400, 420)) and abs(got[420][0] - true[0]) <= 1
