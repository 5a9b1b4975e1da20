"""The quote masks against a state machine that reads character by character."""

import random

import pyarrow as pa
import pytest

from kestrelgrid.operators.record_parsing import header_names, judge_samples, parse_batch, parse_records


def slow(text, delim):
    """(fields, fault) by reading on."""
    fields, field, state, bad = [], "", "start", False
    i = 0
    while i < len(text):
        if state in ("start", "plain", "closed") and text.startswith(delim, i):
            fields.append(field)
            field, state, i = "", "start", i + len(delim)
            continue
        c = text[i]
        if state == "start" and c == '"':
            state = "quoted"
        elif state == "quoted":
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    field += '"'
                    i += 1
                else:
                    state = "closed"
            else:
                field += c
        elif state == "closed":
            bad = True
        else:
            bad |= c == '"'
            field += c
            state = "plain"
        i += 1
    fields.append(field)
    return fields, bad or state == "quoted"


@pytest.mark.parametrize("delim", [",", "\t", "||"])
def test_against_state_machine(delim):
    rnd = random.Random(5)
    raws = ["".join(rnd.choice(['"', delim, "a", "é", "\n", " ", '""', delim + '"', '"' + delim]) for _ in range(rnd.randrange(9))) for _ in range(4000)]
    header = delim.join(["x", "y", "z"])
    fields, reasons, y, none = (x.to_pylist() for x in parse_batch(pa.array(raws), pa.array([delim] * len(raws)), pa.array([header] * len(raws)), ("y", "none")))
    assert y == [f and f[1] for f in fields] and set(none) == {None}
    for raw, got, reason in zip(raws, fields, reasons):
        want, bad = slow(raw, delim)
        assert reason == ("quoting" if bad else "column_count" if len(want) != 3 else None), raw
        if reason is None:
            assert got == want, raw


def test_header_names():
    assert header_names('a;"b;c";d\r', ";") == ["a", "b;c", "d"]


CASES = [
    ("1.5,0.3", None), ("1.5,", None), ("1.5, ", None), ("+1.,.5", None), (" 7e2 ,1E-1", None), ("00:01:02.500,1", None), ("1.5,0.3\r", None), ('"2",1', None),
    ("-1,1", "timestamp"), ("NaN,1", "timestamp"), ("1e999,1", "timestamp"), ("00:61:02.500,1", "timestamp"), ("0:01:02.500,1", "timestamp"), (",1", "timestamp"), ("1_0,1", "timestamp"), ("١,1", "timestamp"),
    ("1,0", "accuracy_h"), ("1,1000", "accuracy_h"), ("1,-2", "accuracy_h"), ("1,<0.5", "accuracy_h"), ("1,inf", "accuracy_h"), ("x,y", "timestamp"),
    ("1", "column_count"), ("1,2,3", "column_count"), ("", "column_count"), (None, "column_count"), ('1,"2', "quoting"), ('1,a"b', "quoting"), ('"1"x,2', "quoting"), ('"a,b",1,2', "column_count"),
]


def test_reasons(spark):
    rows = [(k, 1, k, raw, ",", "timestamp,accuracy_h", "extra") for k, (raw, _) in enumerate(CASES)]
    rows += [(900, 2, 1, "1", None, None, ""), (901, 3, 1, "5|", "|", "accuracy_h|remark", ""), (902, 3, 1, "5|", "|", "accuracy_h|remark", "")]
    df = spark.createDataFrame(rows, "row_id bigint, file_no bigint, line_no int, raw string, delim string, header_line string, fields string")
    got = {r.row_id: r.reason for r in judge_samples(parse_records(df)).collect()}
    for k, (raw, want) in enumerate(CASES):
        assert got[k] == want, raw
    assert got[900] == "no_header" and got[901] is None and got[902] is None
    assert judge_samples(parse_records(df.limit(0))).count() == 0


def test_long_record(spark):
    text = "1,\"" + "x,\"\"" * 200_000 + "\""
    df = spark.createDataFrame([(1, 1, 1, text, ",", "timestamp,remark")], "row_id bigint, file_no bigint, line_no int, raw string, delim string, header_line string")
    row = judge_samples(parse_records(df, ("row_id",), ("timestamp", "accuracy_h", "remark"))).first()
    assert row.reason is None and len(row.f_remark) == 600_000
